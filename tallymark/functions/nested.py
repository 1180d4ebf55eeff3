"""Nested values: JSON paths, rule arrays, provider responses, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERAGE = ("full", "degraded", "none")  # best to worst


def field(document: str | Column, key: str) -> Column:
    """Text of a JSON field; JSON true is the text true."""
    return F.get_json_object(document, f"$.{key}")


def enforced_rules(rows: DataFrame, rules: str = "policy_rules", skip: str = "response_scan.") -> DataFrame:
    """One row a rule, without the rules that only state coverage."""
    return rows.withColumn("rule", F.explode(rules)).where(~F.col("rule").startswith(skip))


def worst(coverages: Column) -> Column:
    """The worst of an array of coverages."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in COVERAGE]), c)
    return F.element_at(F.array(*[F.lit(x) for x in COVERAGE]), F.array_max(F.transform(coverages, rank)).cast("int"))


def tag_name(tag: str | Column) -> Column:
    """Lower case, trimmed, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(tag) if isinstance(tag, str) else tag)), "[ -]", "_")


#: Tags that stand for others: fixed values.
TAG_ALIASES = {"hipaa_basic": "hipaa", "gdpr_basic": "gdpr"}
KNOWN_TAGS = ("default", "soc2", "hipaa", "gdpr")


def resolved_tag(tag: str | Column) -> Column:
    """The tag that decides the checks, null where it is not known."""
    folded = F.lower(F.trim(F.col(tag) if isinstance(tag, str) else tag))
    for alias, name in TAG_ALIASES.items():
        folded = F.when(folded == alias, F.lit(name)).otherwise(folded)
    return F.when(folded.isin(*KNOWN_TAGS), folded)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _member(value: Column, key: str) -> Column:
    """A member of a JSON object; null where it is absent or JSON's null."""
    return bound(F.try_variant_get(value, f"$.{key}", "variant"), lambda v: F.when(~_kind(v, "VOID"), v))


def _items(value: Column) -> Column:
    """The elements of a JSON array; of anything else none."""
    own = F.when(_kind(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    return F.coalesce(own, F.array().cast("array<variant>"))


def _string(value: Column) -> Column:
    return F.when(_kind(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _block(value: Column) -> Column:
    """Text of one block: itself or its member ``text``, if that is a string."""
    return F.coalesce(_string(value), bound(F.try_variant_get(value, "$.text", "variant"), _string), F.lit(""))


def _joined(items: Column, text) -> Column:
    return F.array_join(F.transform(items, text), "")


def _blocks(value: Column) -> Column:
    """Text of a content field: of its blocks one after another, or of the one that it is."""
    return bound(value, lambda v: F.when(_kind(v, "ARRAY"), _joined(_items(v), _block)).otherwise(_block(v)))


def _choice(value: Column) -> Column:
    streamed = lambda d: F.concat(_blocks(_member(d, "content")), _block(F.when(_kind(d, "OBJECT"), d)))
    whole = lambda m: _blocks(_member(m, "content"))
    fields = F.struct(_member(value, "delta").alias("delta"), _member(value, "message").alias("message"))
    either = lambda x: F.concat(F.when(x["delta"].isNotNull(), streamed(x["delta"])).otherwise(""), F.when(x["message"].isNotNull(), whole(x["message"])).otherwise(""))
    return bound(fields, lambda x: F.when(x["delta"].isNull() & x["message"].isNull(), _blocks(_member(value, "text"))).otherwise(either(x)))


SHAPES = ("choices", "candidates", "output", "output_text", "content", "delta", "text")


def understood(value: Column) -> Column:
    """Text of a response object in one of the shapes that providers use, the most specific first; null for any other."""

    def text(m: Column) -> Column:
        return (
            F.when(_kind(m["choices"], "ARRAY"), _joined(_items(m["choices"]), _choice))
            .when(_kind(m["candidates"], "ARRAY"), _joined(_items(m["candidates"]), lambda c: _blocks(_member(_member(c, "content"), "parts"))))
            .when(_kind(m["output"], "ARRAY"), _joined(_items(m["output"]), lambda i: _blocks(_member(i, "content"))))
            .when(_kind(m["output_text"], "STRING"), _string(m["output_text"]))
            .when(m["content"].isNotNull(), _blocks(m["content"]))
            .when(m["delta"].isNotNull(), F.concat(_block(m["delta"]), _blocks(_member(m["delta"], "content"))))
            .otherwise(_string(m["text"]))
        )

    return bound(F.struct(*[_member(value, k).alias(k) for k in SHAPES]), text)


#: Tokens of JSON text whose escaped backslashes and quotes stand as the characters 1 and 2, which JSON text cannot hold.
TOKENS = r'"[^"]*+"(?:\s*+:)?|-?[0-9][0-9.eE+\-]*+|true|false|null|\{\s*+\}|\[\s*+\]'


def leaf_text(raw: str | Column) -> Column:
    """All leaves of a JSON document in its order, one a line; a leaf that is no string is an empty line."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    marked = F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.filter(F.regexp_extract_all(marked, F.lit(TOKENS), F.lit(0)), lambda t: ~(t.startswith('"') & t.endswith(":")))
    whole = lambda t: F.replace(F.replace(t, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    text = lambda t: F.when(t.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), whole(t), F.lit("]")), "array<string>"), 1)).otherwise("")
    return F.array_join(F.transform(tokens, text), "\n")


def _response(value: Column, raw: Column) -> Column:
    """(text, coverage) of one JSON value that is no array: of an object in an unknown shape all leaves."""
    pair = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("coverage"))
    shaped = lambda t: F.when(t.isNotNull(), pair(t, "full")).otherwise(pair(leaf_text(raw), "degraded"))
    return F.when(_kind(value, "STRING"), pair(_string(value), "full")).when(_kind(value, "OBJECT"), bound(understood(value), shaped)).otherwise(pair(F.lit(""), "full"))


def response_text(raw: str | Column) -> Column:
    """Text and coverage of a provider response given as JSON (or plain) text.

    Text that is no JSON is its own text. An array is the chunks of one stream: their texts are joined without a separator and the
    worst coverage counts; an array inside an array gives its leaves, degraded. Numbers, booleans and null hold no text, fully understood.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    leaves = lambda r: F.struct(leaf_text(r).alias("text"), F.lit("degraded").alias("coverage"))
    chunk = lambda v, r: F.when(_kind(v, "ARRAY"), leaves(r)).otherwise(_response(v, r))
    joined = lambda cs: F.struct(F.array_join(F.transform(cs, lambda c: c["text"]), "").alias("text"), F.when(F.size(cs) == 0, "full").otherwise(worst(F.transform(cs, lambda c: c["coverage"]))).alias("coverage"))
    plain = F.struct(F.coalesce(raw, F.lit("")).alias("text"), F.lit("full").alias("coverage"))
    stream = lambda v: bound(F.zip_with(_items(v), F.from_json(raw, "array<string>"), chunk), joined)
    return bound(F.try_parse_json(raw), lambda v: F.when(v.isNull(), plain).when(_kind(v, "ARRAY"), stream(v)).otherwise(_response(v, raw)))
