"""The staff's table browser: a registry says which tables can be opened, searched and filtered, and by what they are ordered.

Being a column is not enough to be filtered by: a filter on a hidden column would tell its value by the number of rows. Filters that
a table does not allow are passed over, and columns that hold secrets are never shown, filtered or searched, whatever the registry says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import ENCRYPTED_ENDING, NEVER_SHOWN, browse

MOST_ROWS = 200  # of a page


@dataclass(frozen=True)
class Entry:
    """A table's key, the columns that a search looks into, and those that can be filtered by equality of text."""

    key: str
    search: tuple[str, ...] = ()
    filterable: tuple[str, ...] = ()


def entry(key: str, search: str = "", filterable: str = "") -> Entry:
    return Entry(key, tuple(search.split()), tuple(filterable.split()))


# The tables of the platform and what may be asked of each.
PLATFORM = {
    "organizations": entry("id", "name contact_email plan_tier", "id name plan_tier subscription_status suspended contact_email"),
    "audit_logs": entry("id", "policy_tag grading_status", "id org_id seq policy_tag grading_status"),
    "org_policies": entry("org_id", "", "org_id"),
    "users": entry("id", "email role", "id org_id email role disabled"),
    "api_keys": entry("id", "name key_prefix status", "id org_id name status"),
    "chain_anchors": entry("id", "chain status tx_hash", "id org_id chain status"),
    "staff_users": entry("id", "email platform_role", "id email platform_role disabled"),
    "admin_actions": entry("id", "action target_type", "id staff_user_id target_org_id action target_type"),
    "traffic_events": entry("id", "site path method", "id org_id site method status_code"),
    "marketing_leads": entry("id", "email name company status source", "id email status source converted_org_id"),
    "stripe_events": entry("id", "type status stripe_event_id", "id org_id type status"),
    "invoices": entry("id", "status currency stripe_invoice_id", "id org_id status stripe_invoice_id"),
    "usage_daily": entry("id", "", "id org_id day"),
    "worker_heartbeat": entry("id", "", "id"),
}


def hidden(column: str) -> bool:
    return column in NEVER_SHOWN or column.endswith(ENCRYPTED_ENDING)


def open_page(tables: Callable[[str], DataFrame], registry: dict[str, Entry], name: str, filters: dict[str, str] | None = None, q: str = "", page: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of a registered table, newest keys first, and its honest total; ``tables`` opens a table by name."""
    if name not in registry:
        raise KeyError(f"{name} is not a registered table")
    if page < 1 or not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"pages count from 1 and hold 1 to {MOST_ROWS} rows")
    spec, df = registry[name], tables(name)
    usable = [c for c in df.columns if not hidden(c)]
    allowed = [c for c in spec.filterable if c in usable]
    asked = {c: v for c, v in (filters or {}).items() if c in allowed and v != ""}
    return browse(df, allowed, asked, [c for c in spec.search if c in usable], q, spec.key, page, limit)


def overview(tables: Callable[[str], DataFrame], registry: dict[str, Entry], asked: dict[str, dict]) -> DataFrame:
    """The same questions put to several tables: table, total, and the keys of the page."""
    out = []
    for name, how in asked.items():
        rows, total = open_page(tables, registry, name, **how)
        out.append(total.join(rows.select(F.col(registry[name].key).cast("string").alias("key")), how="left").select(F.lit(name).alias("table_name"), "total", "key"))  # one row and a page
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
