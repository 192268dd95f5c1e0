"""The budget guard against a plain loop, and the accounting of pairs and linked units by hand."""

import random
from collections import Counter

import pytest

from adjudica.operators import estimators as E
from adjudica.operators import ledger as A
from adjudica.operators import planning as W
from adjudica.plans import core_queries as core
from adjudica.plans import planning_queries as queries
from adjudica.plans.fixtures import table
from adjudica.sources import io

PLAN = "k long, run_id string, pass_number int, provider string, input_tokens long, output_tokens long, micro_usd long"


def looped(rows, caps, by):
    """The guard as one loop: counters grow with each attempt until one would break a cap."""
    done, total, spent = set(), dict.fromkeys(W.COUNTERS, 0), {}
    for n, (k, run, number, provider, i, o, m) in enumerate(sorted(rows)):
        new = {"passes": len(done | {(run, number)}), "attempts": n + 1, "input_tokens": total["input_tokens"] + (i or 0), "output_tokens": total["output_tokens"] + (o or 0), "micro_usd": total["micro_usd"] + (m or 0)}
        own = spent.get(provider, 0) + (m or 0)
        broken = [c for c, cap in caps.items() if new[c] > cap] + (["provider_micro_usd"] if by and provider in by and own > by[provider] else [])
        if broken:
            return n, k, ",".join(broken)
        done.add((run, number))
        total, spent[provider] = new, own
    return len(rows), None, None


@pytest.mark.parametrize("caps", [{}, {"passes": 20}, {"attempts": 33}, {"input_tokens": 900}, {"output_tokens": 0}, {"micro_usd": 700}, {"passes": 25, "attempts": 30, "input_tokens": 1500, "output_tokens": 500, "micro_usd": 800}])
@pytest.mark.parametrize("by", [None, {"a": 300, "b": 10**9}])
def test_guard_equals_a_loop(spark, caps, by):
    r = random.Random(str(caps))
    rows = [(k, f"r{r.randrange(30)}", r.randrange(2), r.choice("abc"), r.randrange(60), r.choice([None, 0, 9, 20]), r.choice([None, 5, 30])) for k in range(120)]
    got = W.budget_guard(spark.createDataFrame(rows, PLAN), ["k"], caps, by, buckets=5).collect()
    n, k, why = looped(rows, caps, by)
    assert sorted(x.k for x in got if x.included) == sorted(x[0] for x in rows)[:n]
    assert [(x.k, x.broken) for x in got if x.broken is not None] == ([] if k is None else [(k, why)])
    assert len(got) == 120


def test_guard_edges(spark):
    with pytest.raises(ValueError, match="euro"):
        W.budget_guard(spark.createDataFrame([], PLAN), ["k"], {"euro": 1})
    assert W.budget_guard(spark.createDataFrame([], PLAN), ["k"], {"passes": 1}).count() == 0


SCENARIOS = {"free": ({}, None), "passes": ({"passes": 20}, None), "attempts": ({"attempts": 33, "micro_usd": 10**9}, None), "none_made": ({"output_tokens": -1}, None), "spent": ({"micro_usd": 300, "input_tokens": 10**9}, {"a": 90, "zz": 1}), "own": ({}, {"b": 60})}


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_stops_equal_a_loop(spark, buckets):
    """Refunds make running sums fall again, so several buckets can hold the first attempt over a cap."""
    r = random.Random(buckets)
    rows = [(k, f"r{r.randrange(30)}", r.randrange(2), r.choice(["a", "b", "c", None]), r.choice([None, r.randrange(60)]), r.choice([None, 0, 9, 20]), r.choice([None, 5, 30, -20])) for k in range(120)]
    got = {x.scenario: tuple(x)[1:] for x in W.budget_stops(spark.createDataFrame(rows, PLAN), ["k"], SCENARIOS, "k", buckets=buckets).collect()}
    for name, (caps, by) in SCENARIOS.items():
        n, k, why = looped(rows, caps, by)
        known = [x[4] for x in rows[:n] if x[4] is not None]
        assert got[name] == (n, sum(known) if known else None, k, why), name


def test_stops_edges(spark):
    empty = spark.createDataFrame([], PLAN)
    with pytest.raises(ValueError, match="euro"):
        W.budget_stops(empty, ["k"], {"x": ({"euro": 1}, None)}, "k")
    with pytest.raises(ValueError, match="run_id"):
        W.budget_stops(empty, ["run_id"], {"x": ({"passes": 1}, None)}, "k")
    assert [tuple(x) for x in W.budget_stops(empty, ["k"], {"x": ({"passes": 1}, {"a": 0})}, "k").collect()] == [("x", 0, None, None, None)]


def test_budget_query_writes_no_attempts(spark, monkeypatch):
    """Fourteen copies of all attempts were checkpointed before."""
    seen, settled = [], W.settled
    monkeypatch.setattr(W, "settled", lambda df: seen.append(settled(df)) or seen[-1])
    data = "/root/testdata/sf0.001"
    assert queries.budget_guard(spark, data).count() == 7
    assert sum(df.count() for df in seen) < table(spark, data, "attempts").count() / 2


def test_pair_causes_by_hand(spark):
    vote = lambda pair, *slots: [(pair, "c1" if pair < 4 else "c2", s, v) for s, v in slots]
    ok, non, fail, unsure, pending = ("COMPLETED", "TIE"), ("COMPLETED", None), ("FAILED", None), ("AMBIGUOUS", None), ("PENDING", None)
    rows = vote(1, ok, ok, ok, ok) + vote(2, ok, ok, ok, non) + vote(3, ok, fail, unsure, non) + vote(4, ok, ok, ok, pending) + vote(5, fail, fail, ok, ok)
    got = {r.category: tuple(r)[1:] for r in A.pair_causes(spark.createDataFrame(rows, "pair_id long, category string, state string, vote string")).select("category", "planned_pairs", "four_valid_pairs", "exactly_three_valid_pairs", "incomplete_pairs", "non_vote_pairs", "terminal_failure_pairs", "ambiguous_pairs", "open_pairs").collect()}
    assert got == {None: (5, 1, 2, 4, 2, 2, 1, 1), "c1": (3, 1, 1, 2, 2, 1, 1, 0), "c2": (2, 0, 1, 2, 0, 1, 0, 1)}


def test_linked_populations_by_hand(spark):
    row = lambda q, unit, pairing, judge, p, o, t=0.0: (q, unit, pairing, judge, "c", t, 1.0, p, o)
    rows = [row("RQ1", "u", "p", "j", "AB", "TIE"), row("RQ1", "u", "p", "j", "AB", None)]
    rows += [row("RQ2", f"u{i}", "p", "j", "AB", "TIE") for i in range(5)] + [row("RQ2", f"v{i}", "q", "j", "AB", "TIE", 0.7 if i else 0.0) for i in range(5)]
    rows += [row("RQ3", "u1", "p", "j", x, "TIE") for x in ("AB", "BA")] + [row("RQ3", "u2", "p", "j", "AB", "TIE")] * 2 + [row("RQ3", "u3", "p", "j", x, o) for x, o in (("AB", None), ("BA", "TIE"))]
    rows += [row("RQ4", "u1", "p", "j", "AB", "TIE")] * 2 + [row("RQ5", "u1", "p", "j", "AB", "TIE")] * 3 + [row("RQ9", "u1", "p", "j", "AB", "TIE")]
    rows += [row("RQ7_PRIMARY", f"u{i}", "p", j, "AB", o) for j, o in (("j", "TIE"), ("k", None)) for i in range(3)]
    df = spark.createDataFrame(rows, "rq_code string, unit_id string, pairing_key string, judge string, condition_code string, temperature double, top_p double, presentation string, outcome string")
    want = {"RQ1": (2, 1), "RQ2": (3, 1), "RQ3": (3, 1), "RQ4": (1, 1), "RQ5": (1, 0), "RQ7_PRIMARY": (2, 1)}
    assert {r.rq_code: (r.planned, r.complete) for r in A.linked_populations(df).collect()} == want
    assert {tuple(r)[1:] for r in A.linked_populations(df.where("false")).collect()} == {(0, 0)}


def test_units_of_all_questions_read_the_pairs_thrice(spark):
    """Ranked slots are counted and placed, all else is one reading; each question joined the texts on its own before (14 joins of them)."""
    plan = queries.planned_units_by_question(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line for line in plan.splitlines()) <= 7


def test_schedule_tasks_are_bounded(spark, monkeypatch):
    """Partitions follow the rows of the schedule; AQE packed it by bytes into as few tasks as shuffles have."""
    monkeypatch.setattr(io, "TASK_ROWS", 100)
    seen, dealt = [], io.dealt
    for m in (W, A):
        monkeypatch.setattr(m, "dealt", lambda df, rows, *keys: seen.append(dealt(df, rows, *keys)) or seen[-1])
    assert queries.schedule_violations(spark, "/root/testdata/sf0.001").count() == 0
    assert len(seen) == 3 and all(df.rdd.getNumPartitions() == 60 for df in seen)


def test_triplets_break_both_rules(spark):
    rows = [(1, "j", "BASELINE", "AB", "TIE"), (1, "j", "DUAL", "AB", "TIE"), (1, "j", "DUAL", "BA", "TIE"), (2, "j", "DUAL", "AB", "TIE"), (2, "j", "DUAL", "BA", None), (3, "j", "BASELINE", "AB", "TIE"), (3, "j", "DUAL", "AB", "TIE"), (3, "j", "DUAL", "BA", "ANSWER_A")]
    got = A.validate_triplets(spark.createDataFrame(rows, "pair_id long, judge string, condition string, presentation string, human_label string"))
    assert sorted(map(tuple, got.collect())) == [("label_drift", "2:j", "2"), ("label_drift", "3:j", "2"), ("linked_structure", "2:j", "")]


@pytest.mark.parametrize("index", [0, 100])
def test_repetition_indices_of_any_size(spark, index):
    """Repeated, missing and large indices, and two identities in one group; equal to a distinct count."""
    rows = [("a", i + index, "r") for i in range(3)] + [("b", index, "r"), ("b", index, "r"), ("c", None, "r"), ("c", index, "r"), ("d", index, "r"), ("d", index + 1, "q"), ("e", None, "r")]
    df = spark.createDataFrame([(g, i, r, "j", "TIE", 1) for g, i, r in rows], "group_key string, repetition_index int, route string, judge string, outcome string, retry_count int")
    got = {x.group_key: (x.n_repetitions, x.exact, x.retries, x.modal) for x in E.repetition_groups(df, ["route"]).collect()}
    assert got == {"a": (3, True, 3, 3), "b": (2, False, 2, 2), "c": (2, False, 2, 2), "d": (2, False, 2, 2), "e": (1, False, 1, 1)}


def test_repetitions_are_folded_before_they_are_sent(spark):
    plan = core.repetition_groups(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and plan.count("HashAggregate") >= 2


def test_complete_cases_read_the_ledger_once(spark):
    df = spark.createDataFrame([(1, "j", "AB", "TIE"), (1, "j", "BA", "TIE"), (2, "j", "AB", "TIE"), (3, "j", "AB", None), (3, "j", "BA", "TIE")], "pair_id long, judge string, presentation string, outcome string")
    five = spark.createDataFrame([("a", None if i == 9 else "TIE") for i in range(5)] + [("b", "TIE")], "group_key string, outcome string")
    got = A.complete_cases(df, five)
    assert sorted(map(tuple, got.collect())) == [("both_orders", 3, 1), ("five_repetitions", 2, 1), ("observations", 5, 4)]
    assert sorted(map(tuple, A.complete_cases(df.limit(0), five.limit(0)).collect())) == [("both_orders", 0, 0), ("five_repetitions", 0, 0), ("observations", 0, 0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


SLOTS = [("a", 2), ("b", 3), ("b", 3), ("c", 1), ("d", None), ("none", 1), (None, 1), ("x", 1), ("x", 2)]
TRIED = [("a", 0, "FAILED"), ("a", 1, "COMPLETED"), ("b", 1, "COMPLETED"), ("b", 1, "FAILED"), ("b", 2, "FAILED"), ("b", 9, "FAILED"), ("b", 9, None), ("c", -1, "COMPLETED"), ("c", None, "FAILED"), ("c", None, "FAILED"), ("d", 7, "FAILED"), ("d", 8, "FAILED"), (None, 3, "FAILED"), (None, 3, "FAILED"), ("o", 5, "COMPLETED"), ("o", 6, "FAILED"), ("x", 4, "FAILED"), ("x", 4, "COMPLETED")]


def looped_violations(slots, tried):
    """The rules of ``validate_ledger``, each over plain lists."""
    named = {p for p, _ in slots}
    out = [("orphan_attempt", p, "") for p, _, _ in tried if p is None or p not in named]
    times = Counter((p, i) for p, i, _ in tried)
    out += [("duplicate_attempt", ":".join(str(x) for x in key if x is not None), str(n)) for key, n in times.items() if n > 1]
    for p, planned in slots:
        own = [(i, s) for q, i, s in tried if q == p and p is not None]
        done, last = min((i for i, s in own if s == "COMPLETED" and i is not None), default=None), max((i for i, _ in own if i is not None), default=None)
        out += [("attempt_count", p, str(len(own)))] if own and planned is not None and planned != len(own) else []
        out += [("replay_after_terminal", p, str(last))] if done is not None and done < last else []
    return out


def test_ledger_rules_equal_a_loop(spark):
    """Slots listed twice, attempts without a slot or a key, numbers without a counter; more orphans of one key than an array of copies holds."""
    tried = TRIED + [("lost", i % 3, "FAILED") for i in range(2500)]
    got = A.validate_ledger(spark.createDataFrame(SLOTS, "pass_id string, attempt_count long"), spark.createDataFrame(tried, "pass_id string, attempt_index int, state string")).collect()
    assert Counter(map(tuple, got)) == Counter(looped_violations(SLOTS, tried))


def test_ledger_rules_read_attempts_once(spark, tmp_path):
    """All rules share one reading, one grouping and one join with the slots; the second reading holds numbers without a counter alone."""
    spark.createDataFrame(SLOTS, "pass_id string, attempt_count long").write.parquet(f"{tmp_path}/slots")
    spark.createDataFrame(TRIED, "pass_id string, attempt_index int, state string").write.parquet(f"{tmp_path}/tried")
    plan = A.validate_ledger(spark.read.parquet(f"{tmp_path}/slots"), spark.read.parquet(f"{tmp_path}/tried"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Relation ") == 3
