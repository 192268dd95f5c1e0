"""Quality rules: a threshold table compiled into one projection of built-in functions.

Counts per text (null: no text): words are runs of anything but space and U+0009-U+000D.

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``)
* ``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to an earlier one)
* ``n_repeat_words``: words inside three-word windows that occur twice or more
* ``n_stop``: words that are stop words once lower-cased

Empty and null texts have zero counts and fail. Repeated rows give repeated results;
an empty table gives an empty result. No shuffle: everything is a function of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lines, text_of, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this "
    "der die und in den von zu das mit sich des auf ein eine nicht ist im dem "
    "de la le et les des en un du une que est pour dans par sur pas au "
    "el los las y que una por con para del se su al no"
)
#: (name, counted, per, lower bound, upper bound) in hundredths; None: no bound. A text
#: fails a rule when 100 * counted is under lower * per or over upper * per.
THRESHOLDS = (
    ("word_length", "word_chars", "n_words", 250, 1200),
    ("symbols", "n_symbols", "n_words", None, 35),
    ("stop_words", "n_stop", "n_words", 2, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)
BASE = (("n_words", "one", 5000, None), ("n_repeat_words", "n_words", None, 50))


def _size(w: Column) -> Column:
    return F.size(w).cast("long")


def window_keys(w: Column) -> Column:
    """A number for each three-word window, in order: its hash, rounded down to a multiple of the number of words, plus its place (null under three words)."""
    n = _size(w)

    def key(i: Column) -> Column:
        h = F.shiftright(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 2)  # differences must not overflow
        return F.coalesce(h - F.pmod(h, n) + i, F.lit(0).cast("long"))

    return F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key)))


def near_twins(keys: Column, w: Column) -> Column:
    """Windows whose hash has a neighbour, as sorted (words, place): all that repeat, and the few whose hashes merely lie close."""
    n = _size(w)
    close = lambda x, k: F.coalesce(x - F.get(keys, k - 1) < n, F.lit(False)) | F.coalesce(F.get(keys, k + 1) - x < n, F.lit(False))

    def window(x: Column) -> Column:
        i = F.pmod(x, n).cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))

    return F.sort_array(F.transform(F.filter(keys, close), window))


def repeat_places(found: Column) -> Column:
    """The places, in order, of the windows that equal a neighbour word for word."""
    same = lambda x, k: F.coalesce(F.get(found, k)["g"] == x["g"], F.lit(False))
    return F.sort_array(F.transform(F.filter(found, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts above, a row for each row."""
    text = F.col("_t")
    df = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    df = df.select("_id", "_t", words(text).alias("_w"), lines(text).alias("_l"))
    stop = sorted(set(STOP_WORDS.split()))
    df = df.select(
        "_id",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop"),
        "_w",
        window_keys(F.col("_w")).alias("_k"),
    )
    df = df.withColumn("_f", near_twins(F.col("_k"), F.col("_w"))).withColumn("_p", repeat_places(F.col("_f")))
    gap = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(3)))
    covered = F.aggregate(F.transform("_p", gap), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop")


def broken(counted: str, per: Column, low: int | None, high: int | None) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | (100 * F.col(counted) < low * per)
    return out if high is None else out | (100 * F.col(counted) > high * per)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``failed_rules`` (names of the broken rules)."""
    df = counts(docs, id_col, text_col)
    per = lambda x: F.lit(1) if x == "one" else F.col(x)
    base = F.lit(False)
    for counted, of, low, high in BASE:
        base = base | broken(counted, per(of), low, high)
    rules = [(name, broken(counted, per(of), low, high)) for name, counted, of, low, high in thresholds]
    ok = ~base
    for _, rule in rules:
        ok = ok & ~rule
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])) if rules else F.array().cast("array<string>")
    return df.select("*", base.alias("base_failed"), ok.alias("kept"), F.array_join(names, ",").alias("failed_rules"))


def duckdb_sql() -> str:
    """The same for DuckDB, compiled from the same table."""
    tests = lambda c, of, lo, hi: " or ".join(([f"100 * {c} < {lo} * {of}"] if lo is not None else []) + ([f"100 * {c} > {hi} * {of}"] if hi is not None else []))
    of = lambda x: "1" if x == "one" else x
    base = " or ".join(tests(c, of(o), lo, hi) for c, o, lo, hi in BASE)
    rules = [(n, tests(c, of(o), lo, hi)) for n, c, o, lo, hi in THRESHOLDS]
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS.split())))
    failed = "concat_ws(',', " + ", ".join(f"case when {t} then '{n}' end" for n, t in rules) + ")"
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
k as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from g),
p as (select distinct r, i + o as i from k, range(0, 3) as x(o) where n > 1),
c as (select r, count(*) as n from p group by r),
s as (select doc_id, len(w) as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
        len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
        len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
        len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop
      from w left join c using (r))
select *, ({base}) as base_failed, not ({base}) and not ({" or ".join(t for _, t in rules)}) as kept, {failed} as failed_rules from s"""
