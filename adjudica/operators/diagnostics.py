"""Historical diagnostics of one judge's decisions, and rankings of answer models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import cases, quality_tier, win_value
from .davidson import fit_davidson  # noqa: F401
from .estimators import KAPPA, kappa_counts
from ..sources.io import settled
from .metrics import by_groups, n_if


def model_pair() -> list[Column]:
    return [F.least("model_a", "model_b").alias("m1"), F.greatest("model_a", "model_b").alias("m2")]


# Consistency ----------------------------------------------------------------------------------
def position_consistency(d: DataFrame) -> DataFrame:
    """Win rate of the first model in either slot for each category and model pair seen in both orders; ``flip`` if they straddle 0.5."""
    first_in_a = F.when(F.col("position_a_id") == F.col("answer_a_id"), F.col("model_a")).otherwise(F.col("model_b"))
    rows = d.select("category", *model_pair(), first_in_a.alias("shown"), "winner_model")
    won = F.coalesce(F.col("winner_model") == F.col("m1"), F.lit(False))
    at = lambda m: F.col("shown") == F.col(m)
    g = rows.groupBy("category", "m1", "m2").agg(n_if(at("m1")).alias("n_a"), n_if(at("m2")).alias("n_b"), n_if(at("m1") & won).alias("w_a"), n_if(at("m2") & won).alias("w_b")).where("n_a > 0 and n_b > 0")
    return g.select("category", "m1", "m2", "n_a", "n_b", (F.col("w_a") / F.col("n_a")).alias("rate_slot_a"), (F.col("w_b") / F.col("n_b")).alias("rate_slot_b"), ((2 * F.col("w_a") > F.col("n_a")) != (2 * F.col("w_b") > F.col("n_b"))).alias("flip"))


def category_winners(d: DataFrame) -> DataFrame:
    """Win rate (three decimals, half-even) and winner of each pair and category; a rounded 0.5 is a TIE."""
    won = F.coalesce(F.col("winner_model") == F.col("m1"), F.lit(False))
    g = d.select("category", *model_pair(), "winner_model").groupBy("m1", "m2", "category").agg(F.count("*").alias("total"), n_if(won).alias("m1_wins"))
    rate = F.bround(F.col("m1_wins") / F.col("total"), 3)
    return g.select("m1", "m2", "category", "total", "m1_wins", rate.alias("m1_win_rate"), cases((rate > 0.5, F.col("m1")), (rate < 0.5, F.col("m2")), otherwise="TIE").alias("category_winner"))


def pair_variety(winners: DataFrame) -> DataFrame:
    """Distinct category winners of each pair."""
    return winners.groupBy("m1", "m2").agg(F.count_distinct("category_winner").alias("distinct_winners")).withColumn("specialised", F.col("distinct_winners") > 1)


def consistency_score(positions: DataFrame, variety: DataFrame) -> DataFrame:
    """Position consistency (1.0 without swapped groups) and share of specialised pairs."""
    p = positions.agg(F.count("*").alias("swapped"), n_if(F.col("flip")).alias("flips"))
    v = variety.agg(F.count("*").alias("pairs"), n_if(F.col("specialised")).alias("special"))
    return p.crossJoin(F.broadcast(v)).select("swapped", "flips", F.when(F.col("swapped") > 0, (F.col("swapped") - F.col("flips")) / F.col("swapped")).otherwise(1.0).alias("position_consistency"), F.when(F.col("pairs") > 0, F.col("special") / F.col("pairs")).otherwise(0.0).alias("specialisation_rate"))


def top_varied_pairs(variety: DataFrame, k: int = 3) -> DataFrame:
    """The k pairs with the most distinct winners, ties by name (a top-k: no full sort)."""
    return variety.orderBy(F.desc("distinct_winners"), "m1", "m2").limit(k)


# Slots and formats ----------------------------------------------------------------------------
def slot_totals(d: DataFrame, groups=((),)) -> DataFrame:
    """Wins of slot A and B and ties, and the chi-square of an even split (0 without decisions)."""
    w, p = F.col("winner_id"), F.col("position_a_id")
    g = by_groups(d, groups, n_if(w == p).alias("position_a"), n_if(w != p).alias("position_b"), n_if(w.isNull()).alias("tie"))
    gap, n = F.col("position_a") - F.col("position_b"), F.col("position_a") + F.col("position_b")
    return g.withColumn("chi2", F.when(n > 0, gap * gap / n).otherwise(0.0))


def length_points(d: DataFrame) -> DataFrame:
    w = F.col("winner_id")
    verdict = cases((w.isNull(), 0.5), (w == F.col("answer_a_id"), 1.0), otherwise=0.0)
    return d.select("id", (F.col("wc_a") - F.col("wc_b")).alias("word_count_diff"), verdict.alias("llm_verdict"))


def format_association(d: DataFrame) -> DataFrame:
    """Chosen formats over decided pairs of unlike formats; null statistics without any."""
    used = d.where((F.col("format_a") != F.col("format_b")) & F.col("winner_id").isNotNull())
    chosen = F.when(F.col("winner_id") == F.col("answer_a_id"), F.col("format_a")).otherwise(F.col("format_b"))
    g = used.agg(n_if(chosen == "markdown_heavy").alias("markdown_chosen"), n_if(chosen != "markdown_heavy").alias("plain_text_chosen"))
    gap, n = F.col("markdown_chosen") - F.col("plain_text_chosen"), F.col("markdown_chosen") + F.col("plain_text_chosen")
    return g.withColumn("chi2", F.when(n > 0, gap * gap / n))


def pair_kappa(labelled: DataFrame, groups=((),)) -> DataFrame:
    """Kappa, agreement and overlap of two label columns ``human_label`` and ``judge_label``."""
    wide = by_groups(labelled, groups, *kappa_counts("human_label", "judge_label", F.lit(True)))
    return wide.select(*[k for g in groups for k in g], F.col("valid_n").alias("overlap"), F.expr(KAPPA).alias("kappa"), F.when(F.col("valid_n") > 0, F.col("agree") / F.col("valid_n")).alias("agreement"))


def inter_judge_kappa(labelled: DataFrame) -> DataFrame:
    """Undefined kappa and agreement are 0 here."""
    return pair_kappa(labelled).na.fill(0.0, ["kappa", "agreement"])


def domain_kappa(labelled: DataFrame) -> DataFrame:
    """Kappa by category; null for a single row or where it is undefined."""
    return pair_kappa(labelled, (("category",),)).withColumn("kappa", F.when(F.col("overlap") > 1, F.col("kappa"))).drop("agreement")


def case_buckets(d: DataFrame, words: int = 50) -> DataFrame:
    """Cases in up to four buckets each; ``d`` holds a human and a judge label and word counts."""
    h, j, gap = F.col("human_label"), F.col("judge_label"), F.col("wc_a") - F.col("wc_b")
    long_choice = ((j == "ANSWER_A") & (gap > words)) | ((j == "ANSWER_B") & (-gap > words))
    short = (h == "TIE") | ((h == "ANSWER_A") & (gap < 0)) | ((h == "ANSWER_B") & (gap > 0))
    shown_b = ((j == "ANSWER_A") & (F.col("position_a_id") == F.col("answer_b_id"))) | ((j == "ANSWER_B") & (F.col("position_a_id") == F.col("answer_a_id")))
    tests = [("length", long_choice & short), ("forced_choice", (h == "TIE") & (j != "TIE")), ("slot", shown_b), ("baseline", h == j)]
    named = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
    return d.select("id", F.explode(named).alias("bucket"), gap.alias("word_count_diff"), h.alias("human_winner"), j.alias("ai_winner"), F.concat_ws(" vs ", "model_a", "model_b").alias("model_names"))


def bh_adjust(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over a small table of tests: monotone, at most 1, ``fdr_significant``."""
    up = Window.orderBy(p, key)
    down = Window.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    raw = df.withColumn("_k", F.row_number().over(up)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    adjusted = raw.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_k")).over(down)))
    return adjusted.drop("_k", "_n").withColumn("fdr_significant", F.col("p_adjusted") < alpha)


# Length regression and neutralised scores -----------------------------------------------------
def length_regression(points: DataFrame, x: str = "word_count_diff", y: str = "llm_verdict") -> DataFrame:
    """Least squares from exact integer sums: slope, intercept, R2 and the slope's standard error."""
    a, b = F.col(x).cast("long"), (2 * F.col(y)).cast("long")  # verdicts are halves
    s = points.agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))
    return s.select("n", *(F.expr(e).alias(k) for k, e in REGRESSION.items()))


_V, _C, _W = "(cast(n as double) * sxx - cast(sx as double) * sx)", "(cast(n as double) * sxy - cast(sx as double) * sy)", "(cast(n as double) * syy - cast(sy as double) * sy)"
_R2 = f"({_C} * {_C}) / ({_V} * {_W})"
REGRESSION = {
    "slope": f"{_C} / {_V} / 2",
    "intercept": f"(sy - {_C} / {_V} * sx) / n / 2",
    "r2": _R2,
    "slope_se": f"sqrt(greatest(0.0, (1 - {_R2}) * {_W} / {_V} / (n - 2))) / 2",
}


def cv_residuals(d: DataFrame, k: int = 5) -> DataFrame:
    """Out-of-fold residuals: sums for each fold in one pass, training sums are the total less the fold's own."""
    base = d.select("id", "model_a", "model_b", (F.col("wc_a") - F.col("wc_b")).cast("long").alias("x"), (2 * win_value("winner_id", "answer_a_id", "answer_b_id")).cast("long").alias("y2"), (F.conv(F.substring(F.sha2(F.concat(F.lit("fold:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long") % k).alias("fold"))
    x, y = F.col("x"), F.col("y2")
    folds = base.groupBy("fold").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    every = Window.partitionBy(F.lit(1))  # k rows
    train = folds.select("fold", *((F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    fits = train.select("fold", F.expr(REGRESSION["slope"]).alias("slope"), F.expr(REGRESSION["intercept"]).alias("intercept"))
    return base.join(F.broadcast(fits), "fold").select("id", "model_a", "model_b", "fold", "x", (y / 2).alias("a_wins"), (y / 2 - F.col("intercept") - F.col("slope") * x).alias("residual"))


def cv_metrics(residuals: DataFrame) -> DataFrame:
    """Mean out-of-fold R2 and the correlation of residuals with the length difference."""
    f = residuals.groupBy("fold").agg(F.sum(F.col("residual") ** 2).alias("ss"), (F.var_pop("a_wins") * F.count("*")).alias("st"))
    r2 = f.agg(F.avg(F.when(F.col("st") > 0, 1 - F.col("ss") / F.col("st")).otherwise(0.0)).alias("mean_cv_r2"))
    return r2.crossJoin(residuals.agg(F.corr("residual", "x").alias("cv_residual_length_corr")))


def neutralized_scores(residuals: DataFrame) -> DataFrame:
    """Mean signed residual, its deviation and the raw win rate (ties count as games) of each model, with both ranks."""
    r, w = F.col("residual"), F.col("a_wins")
    sides = F.array(F.struct(F.col("model_a").alias("model"), r.alias("e"), (w == 1).cast("int").alias("won")), F.struct(F.col("model_b").alias("model"), (-r).alias("e"), (w == 0).cast("int").alias("won")))
    g = residuals.select(F.inline(sides)).groupBy("model").agg(F.count("*").alias("total_games"), (F.sum("won") / F.count("*")).alias("raw_win_rate"), F.avg("e").alias("neutralized_score"), F.stddev_samp("e").alias("residual_std"))
    # a row for each model
    ranks = g.withColumn("rank_raw", F.rank().over(Window.orderBy(F.desc("raw_win_rate")))).withColumn("rank_neutralized", F.row_number().over(Window.orderBy(F.desc("neutralized_score"), "model")))
    return ranks.withColumn("rank_change", F.col("rank_raw") - F.col("rank_neutralized"))


def raw_win_rates(d: DataFrame) -> DataFrame:
    """Wins over decided games; a model without any has 0."""
    a_won = F.col("winner_id") == F.col("answer_a_id")
    b_won = F.col("winner_id") == F.col("answer_b_id")
    sides = F.array(*(F.struct(F.col(m).alias("model"), F.coalesce(won.cast("int"), F.lit(0)).alias("won"), F.col("winner_id").isNotNull().cast("int").alias("game")) for m, won in (("model_a", a_won), ("model_b", b_won))))
    g = d.select(F.inline(sides)).groupBy("model").agg(F.sum("won").alias("wins"), F.sum("game").alias("games"))
    return g.withColumn("win_rate", F.when(F.col("games") > 0, F.col("wins") / F.col("games")).otherwise(0.0))


def pair_edges(d: DataFrame) -> DataFrame:
    """Wins and ties of each unordered model pair; pairs of a model with itself are left out."""
    lo = F.col("model_a") < F.col("model_b")
    won = cases((F.col("winner_id") == F.col("answer_a_id"), F.when(lo, "i").otherwise("j")), (F.col("winner_id") == F.col("answer_b_id"), F.when(lo, "j").otherwise("i")), otherwise="t")
    rows = d.where("model_a <> model_b").select(*model_pair(), won.alias("o"))
    return rows.groupBy("m1", "m2").agg(n_if(F.col("o") == "i").alias("w_ij"), n_if(F.col("o") == "j").alias("w_ji"), n_if(F.col("o") == "t").alias("t_ij"))


def rank_models(scores: DataFrame) -> DataFrame:
    """Rank by score, tier and provider bucket."""
    m = F.col("model")
    provider = cases((m.contains("gpt"), "OpenAI"), (m.contains("claude"), "Anthropic"), (m.contains("llama"), "Meta"), otherwise="Other")
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "model"))).withColumn("quality_tier", quality_tier("score")).withColumn("provider", provider)


def spearman(points: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, from counts of distinct pairs of values only; ``points`` is read once."""
    cells = settled(points.groupBy(x, y).agg(F.count("*").alias("c")))

    def ranks(c: str) -> DataFrame:
        """Twice the average rank of each distinct value: exact. Sums of range partitions come first, so no task sorts all values."""
        parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        v = settled(cells.groupBy(F.col(c).alias(c)).agg(F.sum("c").alias("n")).repartitionByRange(parts, c).withColumn("_b", F.spark_partition_id()))
        sums = v.groupBy("_b").agg(F.sum("n").alias("s"))
        starts = sums.select("_b", (F.sum("s").over(Window.orderBy("_b")) - F.col("s")).alias("_start"))  # a row for each partition
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_b").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
        return v.join(F.broadcast(starts), "_b").select(c, (2 * before + F.col("n") + 1).alias(f"r_{c}"))

    ranked = cells.join(ranks(x), x).join(ranks(y), y)
    a, b, c = F.col(f"r_{x}").cast("decimal(20,0)"), F.col(f"r_{y}").cast("decimal(20,0)"), F.col("c").cast("decimal(12,0)")
    d = lambda e: F.sum(e).cast("double")
    s = ranked.agg(d(c).alias("n"), d(c * a).alias("sa"), d(c * b).alias("sb"), d((c * a).cast("decimal(30,0)") * a).alias("saa"), d((c * b).cast("decimal(30,0)") * b).alias("sbb"), d((c * a).cast("decimal(30,0)") * b).alias("sab"))
    return s.select("n", F.expr("(n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))").alias("rho"))


def trend_points(regression: DataFrame, xs: list[int]) -> DataFrame:
    """Points of the fitted line, kept within [0, 1]."""
    y = F.col("intercept") + F.col("slope") * F.col("x")
    return regression.select("intercept", "slope", F.explode(F.array(*map(F.lit, xs))).alias("x")).select("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)).alias("y"))
