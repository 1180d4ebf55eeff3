"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The models are first-order chains over the characters of a token, two trained from random strings (base64 and hexadecimal
digits), one from ordinary tokens. A token whose log-likelihood ratio speaks for a random model, in total and for each character,
is a span of kind ``random``. Everything is built from DataFrame functions: the chains are arrays of log ratios that a scalar
subquery hands to the scan, so there is no shuffle of texts and no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed patterns by kind, the group whose length counts, and the least length.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: A pattern that occurs in a text wherever one of that kind that passes does: most texts are done after it.
GATES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_=-]{20}",
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]+"
TOKEN_LENGTH = 20
KINDS = ("assign", "access", "hex", "random")
SOME_HITS = 512  # hits of a text are gathered in arrays of so many, so that a text with very many does not copy them each time


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank of the kind, end, kind, value) of the matches whose group is long enough.

    Starts follow from the lengths of what stands between the matches, in code points.
    """
    rank = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("v"))), between, lambda m, gap: F.struct(m["n"].alias("n"), m["v"].alias("v"), F.length(gap).alias("gap")))
    row = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        hit = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        counts, full = F.length(x["v"]) >= least, F.size(acc["some"]) >= SOME_HITS
        some = F.when(counts, F.when(full, hit).otherwise(F.concat(acc["some"], hit))).otherwise(acc["some"])
        done = F.when(counts & full, F.concat(acc["done"], F.array(acc["some"]))).otherwise(acc["done"])
        return F.struct((start + F.coalesce(x["n"], F.lit(0))).alias("at"), some.alias("some"), done.alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(row).alias("some"), F.array().cast(f"array<{row}>").alias("done"))
    walked = F.aggregate(steps, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["some"]))))
    return F.when(text.rlike(GATES[kind]), walked).otherwise(F.array().cast(row))


def pair_index(token: Column) -> Column:
    """For each pair of neighbouring characters its place in the table of ratios; characters are taken one by one once."""
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * n + b)


def pair_counts(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.select(*by, F.explode(pair_index(F.col("token"))).alias("pair")).groupBy(*by, "pair").agg(F.count("*").alias("n"))


def random_tokens(docs: DataFrame, n: int = 2000) -> DataFrame:
    """Labelled random strings of two kinds: digests of numbers in base64 and in hexadecimal digits."""
    hexed = F.sha2(F.concat(F.lit("random-"), F.col("id")), 256)
    ids = docs.sparkSession.range(n)
    return ids.select(F.lit(0).alias("model"), F.base64(F.unhex(hexed)).alias("token")).unionByName(ids.select(F.lit(1).alias("model"), hexed.alias("token")))


def ordinary_tokens(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """Labelled ordinary tokens: all of about ``sample_docs`` whole documents, chosen by a hash of doc_id, without those
    that a fixed pattern would take for a secret. The bound is a parameter: the model has a few thousand numbers."""
    n = docs.count()
    draw = F.xxhash64("doc_id", F.lit("token-sample")) / F.lit(2.0**64) + 0.5
    token = F.explode(F.regexp_extract_all(text_or_empty(), F.lit(TOKEN), F.lit(0))).alias("token")
    return docs.where(draw < sample_docs / max(n, 1)).select(token).where(~F.col("token").rlike("[0-9a-f]{16}|[A-Z0-9]{16}") & (F.length("token") >= 2))


def train(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """One row with an array for each random model: log2 of P(next | character) under it over that under the ordinary model."""
    n = len(ALPHABET)
    grid = random.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("pair"))
    both = grid.join(pair_counts(random, "model").withColumnRenamed("n", "r"), ["model", "pair"], "left").join(pair_counts(ordinary).withColumnRenamed("n", "o"), "pair", "left")
    rows = both.select("model", "pair", F.floor(F.col("pair") / n).alias("from"), (F.coalesce("r", F.lit(0)) + 0.5).alias("r"), (F.coalesce("o", F.lit(0)) + 0.5).alias("o"))
    totals = rows.groupBy("model", "from").agg(F.sum("r").alias("rt"), F.sum("o").alias("ot"))
    ratio = F.log2(F.col("r") / F.col("rt")) - F.log2(F.col("o") / F.col("ot"))
    each = rows.join(totals, ["model", "from"]).groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", ratio.alias("x")))), lambda s: s["x"]).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "x"))), lambda s: s["x"]).alias("ratios"))


def find_secrets(docs: DataFrame, model: DataFrame, least_bits: float = 20.0, bits_per_char: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Whole texts; null counts as empty and gives no spans. Spans are kind:start:end in code points, by start and then
    kind. The fixed patterns' spans are all kept; the models add those of kind ``random``. Repeated rows give repeated
    results and columns other than doc_id and text are not read. Ties cannot occur: a start holds one span of a kind.
    """
    text = F.col("t")
    rows = docs.select("doc_id", text_or_empty().alias("t"))
    for kind, (pattern, group, least) in PATTERNS.items():
        rows = rows.withColumn(kind, spans(text, kind, pattern, group, least))
    rows = rows.withColumn("tokens", spans(text, "random", TOKEN, 0, TOKEN_LENGTH)).drop("t")
    rows = rows.withColumn("ratios", F.when(F.size("tokens") > 0, model.select("ratios").scalar()))

    def bits(token: Column) -> Column:
        """The ratio under the random model that explains the token best."""
        total = lambda x: F.aggregate(F.transform(pair_index(token["value"]), lambda i: F.get(x, i)), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
        return F.coalesce(F.array_max(F.transform("ratios", total)), F.lit(0.0))

    scored = F.transform("tokens", lambda s: F.struct(s.alias("s"), bits(s).alias("bits")))
    random = F.filter(scored, lambda x: (x["bits"] >= least_bits) & (x["bits"] >= bits_per_char * F.length(x["s"]["value"])))
    rows = rows.withColumn("random", F.transform(random, lambda x: x["s"]))
    joined = lambda spans_: F.array_join(F.transform(F.array_sort(spans_), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.concat("assign", "access", "hex")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
