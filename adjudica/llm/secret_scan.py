"""Secret scans with multipart credential linking, in built-in functions only.

Base spans (leftmost, not overlapping, for each kind; ends exclusive, in code points) are
always reported. Weak parts - an account name, a bare mixed token, an endpoint - are
candidates only: an interval join (windows over the parts of a text) shows which other parts
stand in the same scope, and a weak part is reported when its complement is there:

* an account name with a secret,
* a bare token with an identifier or an endpoint,
* an endpoint with both an identifier and a secret.

A scope is a run of lines without a blank line between, of any length. A ``reach``, if given,
bounds the gap between two linked parts (end of the earlier to start of the later). Only parts, never texts, are
shuffled. Null and empty texts have no spans (the digest is that of an empty string).
Rows with equal id and text are scanned alike, each keeps its own result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: The base patterns, in the order in which equal starts are listed.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("account", r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0, 0),
    ("bare", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}", 0, 0),
    ("endpoint", r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D"'<>]+""", 0, 0),
)
KINDS = [kind for kind, *_ in BASE + WEAK]
SPAN = "array<struct<s:int,k:int,e:int>>"
#: Matches whose offsets are summed in one go.
BLOCK = 256


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern: the pieces between matches and the matches give all offsets.

    The base quantifiers are folded into the pattern only where that selects the same
    matches (maximal runs); the assigned value is tested after matching. Offsets are summed by
    blocks of matches, so that no long list is copied for each match: work follows the number of matches.
    """
    hits = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    widths = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), hits(0), lambda p, h: F.struct(F.length(p).alias("p"), F.coalesce(F.length(h), F.lit(-1)).alias("h"))),
        hits(group),
        lambda x, g: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.coalesce(F.length(g), F.lit(0)).alias("g")),
    )

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        e = s + x["h"]
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        good = (x["h"] >= 0) & (x["g"] >= least)
        return F.struct(e.alias("at"), F.when(good, F.concat(acc["got"], one)).otherwise(acc["got"]).alias("got"))

    def block_step(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("got")), step)
        return F.get(F.transform(F.array(done), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["got"], F.array(x["got"])).alias("got"))), F.lit(0))

    def by_blocks(hits: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hits) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(hits, i + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("got")), block_step, lambda acc: F.flatten(acc["got"]))

    found = F.get(F.transform(F.array(F.filter(widths, lambda x: x["h"] >= 0)), by_blocks), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.sort_array(found), one), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """``id_col``, counts of base spans, ``base_sha256``, ``spans`` and ``n_linked`` (weak parts reported)."""
    text, scope = F.col("_t"), r"\n[\x20\t\r]*\n"
    df = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    df = df.select("_id", F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.lit(":"), text)).alias("_key"), *(spans(text, i, *rest).alias(kind) for i, (kind, *rest) in enumerate(BASE + WEAK)), spans(text, 9, scope, 0, 0).alias("_cuts"))
    df = df.select("_id", "_key", *KINDS[:3], F.concat(*KINDS[:3]).alias("_base"), F.concat(*KINDS[3:]).alias("_weak"), "_cuts")

    # The interval join: each part sees which others stand in its own scope, and within reach.
    parts = df.where(F.size("_weak") > 0).dropDuplicates(["_key"]).select("_key", F.explode(F.concat("_base", "_weak", "_cuts")).alias("x")).select("_key", "x.*")
    by_start = Window.partitionBy("_key").orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("scope", F.sum((F.col("k") == 9).cast("int")).over(by_start)).where("k < 9")
    scope_of = Window.partitionBy("_key", "scope")
    before = scope_of.orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, -1)
    after = scope_of.orderBy(F.desc("s"), F.desc("k"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)

    def has(kinds: list[int]) -> Column:
        some = F.col("k").isin(kinds)
        if reach is None:
            return F.max(some.cast("int")).over(scope_of)
        gap = F.least(F.col("s") - F.max(F.when(some, F.col("e"))).over(before), F.min(F.when(some, F.col("s"))).over(after) - F.col("e"))
        return (some | F.coalesce(gap <= reach, F.lit(False))).cast("int")

    k = lambda name: KINDS.index(name)
    parts = parts.select("_key", "s", "k", "e", has([k("access"), k("account")]).alias("ids"), has([k("assign"), k("hex"), k("bare")]).alias("secrets"), has([k("endpoint")]).alias("ends"))
    shown = F.when(F.col("k") == k("account"), F.col("secrets") == 1).when(F.col("k") == k("bare"), F.col("ids") + F.col("ends") > 0).when(F.col("k") == k("endpoint"), F.col("ids") + F.col("secrets") == 2)
    linked = parts.where(shown).groupBy("_key").agg(F.collect_list(F.struct("s", "k", "e")).alias("_linked"))

    df = df.drop("_weak", "_cuts").join(linked, "_key", "left")
    return df.select(
        F.col("_id").alias(id_col),
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.concat("_base", F.coalesce("_linked", F.array().cast(SPAN)))).alias("spans"),
        F.size(F.coalesce("_linked", F.array().cast(SPAN))).cast("long").alias("n_linked"),
    )
