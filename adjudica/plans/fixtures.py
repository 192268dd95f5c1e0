"""Judge-shaped tables derived from ``orders``, ``documents`` and ``conversations``.

The library's operators know nothing of these: they only feed its queries. One SQL text in the
common subset of Spark and DuckDB defines each table, so both engines see the same rows. All
choices are hash arithmetic on the order key, hence independent of partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Judges, providers, answer models and categories of the study.
JUDGES = ("gpt-4o-mini", "anthropic/claude-3-haiku", "deepseek/deepseek-chat", "meta-llama/llama-3.3-70b-instruct")
MODELS = ("gpt-3.5-turbo", "gpt-4", "claude-v1", "llama-13b", "alpaca-13b", "vicuna-13b")
CATEGORIES = ("writing", "roleplay", "reasoning", "math", "coding", "extraction", "stem", "humanities")


def pick(index: str, names: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when {index} = {i} then '{n}'" for i, n in enumerate(names)) + " end"


def outcome(v: str, followed: str) -> str:
    """Displayed outcome of a draw 0-99."""
    return f"""case when {v} < 40 then {followed} when {v} < 58 then 'ANSWER_A' when {v} < 74 then 'ANSWER_B' when {v} < 88 then 'TIE'
      when {v} < 91 then 'UNKNOWN' when {v} < 93 then 'INVALID_RESPONSE' when {v} < 95 then 'API_ERROR' when {v} < 96 then 'TIMEOUT' when {v} < 97 then 'REFUSAL' end"""


SHOWN = "case when human_label is null or human_label = 'TIE' then 'TIE' when (human_label = 'ANSWER_A') = (presentation = 'AB') then 'ANSWER_A' else 'ANSWER_B' end"
_JUDGES = "(values " + ", ".join(f"('{j}', {i})" for i, j in enumerate(JUDGES)) + ") as j(judge, judge_no)"
_ORDERS = "(values ('AB'), ('BA')) as o(presentation)"

TABLES: dict[str, str] = {
    "keys": "select o_orderkey as k, o_custkey as c, cast(o_orderkey as string) as s from orders",
    "drawn": f"select k, c, s, h('ma:' || s) % 6 as ia, (h('ma:' || s) % 6 + 1 + h('mb:' || s) % 5) % 6 as ib, 20 + h('wa:' || s) % 400 as wc_a, 20 + h('wb:' || s) % 400 as wc_b, h('hl:' || s) % 100 as hl from keys",
    "pairs": f"""select k as pair_id, c as prompt_id, 81 + c % 80 as question_id, {pick("c % 8", CATEGORIES)} as category,
      2 * k + 1 as answer_a_id, 2 * k + 2 as answer_b_id, {pick("ia", MODELS)} as model_a, {pick("ib", MODELS)} as model_b, wc_a, wc_b,
      case when hl < 45 then 'ANSWER_A' when hl < 75 then 'ANSWER_B' when hl < 95 then 'TIE' end as human_label, s from drawn""",
    "preferences": """select 2 * pair_id as preference_id, prompt_id, answer_a_id, answer_b_id, case human_label when 'ANSWER_A' then answer_a_id when 'ANSWER_B' then answer_b_id end as winner_id from pairs where human_label is not null
      union all select 2 * pair_id + 1, prompt_id, answer_b_id, answer_a_id, case when h('cf:' || s) % 5 = 0 then case human_label when 'ANSWER_A' then answer_b_id when 'ANSWER_B' then null else answer_a_id end
        else case human_label when 'ANSWER_A' then answer_a_id when 'ANSWER_B' then answer_b_id end end from pairs where human_label is not null and pair_id % 4 = 0""",
    "answers": """select answer_a_id as id, prompt_id, model_a as model_name, wc_a as word_count, case when wc_a % 7 = 0 then '' when wc_a % 3 = 0 then '# Head' || chr(10) || '- **item** ' || s else 'plain text ' || s end as text from pairs
      union all select answer_b_id, prompt_id, model_b, wc_b, case when wc_b % 3 = 0 then '1. one' || chr(10) || '**two** ' || s else 'plain words ' || s end from pairs""",
    "prompts": "select distinct prompt_id as id, category, 'prompt ' || cast(prompt_id as string) as text from pairs",
    "slots0": f"select p.*, j.judge, j.judge_no, o.presentation, h('o:' || s || ':' || judge || ':' || presentation || ':0') % 100 as v, h('b:' || s || ':' || judge || ':AB:0') % 100 as vb from pairs p cross join {_JUDGES} cross join {_ORDERS}",
    "passes": f"""select pair_id, question_id, category, prompt_id, answer_a_id, answer_b_id, model_a, model_b, wc_a, wc_b, human_label, judge, judge_no, presentation, s,
      s || ':' || judge || ':' || presentation as pass_id, {outcome("v", SHOWN)} as outcome from slots0""",
    "repetitions": f"""select pair_id, question_id, category, judge, rep as repetition_index, s || ':' || judge as group_key, h('rt:' || s || judge || cast(rep as string)) % 3 as retry_count, human_label,
      {outcome("v", SHOWN)} as outcome, answer_a_id, answer_b_id, case when pair_id % 70 = 0 and rep = 4 then 'route-b' else 'route-a' end as route from (
        select p.*, j.judge, r.rep, 'AB' as presentation, case when h('rk:' || s || ':' || judge || ':' || cast(rep as string)) % 10 = 0 then h('o:' || s || ':' || judge || ':AB:' || cast(rep as string)) % 100 else h('o:' || s || ':' || judge || ':AB:0') % 100 end as v
        from pairs p cross join {_JUDGES} cross join (values (0), (1), (2), (3), (4)) as r(rep)) x""",
    "baseline": f"select pair_id, judge, {outcome('vb', SHOWN)} as baseline_label from slots0 where presentation = 'AB'",
    "votes": """select pair_id, category, question_id, human_label, judge, judge_no, presentation, answer_a_id, answer_b_id, outcome, s from passes
      where (presentation = 'AB') = ((judge_no + h('pr:' || s) % 4) % 4 < 2)""",
    "decisions": """select pair_id as id, prompt_id, case when pair_id % 50 = 0 then 'live' else category end as category, judge as judge_model_name, answer_a_id, answer_b_id, model_a, model_b, wc_a, wc_b, human_label,
      case when h('pa:' || s) % 2 = 0 then answer_a_id else answer_b_id end as position_a_id, case outcome when 'ANSWER_A' then answer_a_id when 'ANSWER_B' then answer_b_id end as winner_id
      from passes where presentation = 'AB' and outcome in ('ANSWER_A', 'ANSWER_B', 'TIE')""",
    "attempts": """select pass_id, pair_id, judge, case judge_no when 0 then 'openai' else 'openrouter' end as provider, i as attempt_index, n as attempt_count, case when i < n then 'FAILED' when outcome is null then 'AMBIGUOUS' when outcome in ('API_ERROR', 'TIMEOUT', 'REFUSAL') then 'FAILED' else 'COMPLETED' end as state,
      case when i < n then case h('fc:' || pass_id || cast(i as string)) % 3 when 0 then 'RATE_LIMIT' when 1 then 'HTTP_5XX' else 'TIMEOUT' end when outcome in ('API_ERROR', 'TIMEOUT', 'REFUSAL') then outcome end as failure_category,
      100 + h('ti:' || pass_id || cast(i as string)) % 900 as input_tokens, 10 + h('to:' || pass_id || cast(i as string)) % 200 as output_tokens,
      case when h('rc:' || pass_id || cast(i as string)) % 3 > 0 then h('ac:' || pass_id || cast(i as string)) % 5000 end as actual_micro_usd, 5000 as reserved_micro_usd, 60 * pair_id + i as started_min
      from (select pass_id, pair_id, judge, judge_no, outcome, 1 + h('n:' || pass_id) % 3 as n from passes where presentation = 'AB') p cross join (values (1), (2), (3)) as a(i) where i <= n""",
    "ledger": """select pass_id, s, pair_id, judge, presentation, outcome, case h('cl:' || pass_id) % 4 when 0 then 'CORRECTED_RERUN_REQUIRED' when 1 then 'HISTORICAL_ONLY_UNALIGNED' else 'SOURCE_CORRECT_REUSABLE' end as classification, case when h('rq:' || s) % 2 = 0 then 'RQ1' else 'RQ3' end as rq_code from passes""",
    "corrected": f"select pass_id as historical_identity, 'c:' || pass_id as planned_pass_id, rq_code, judge, presentation, case h('st:' || pass_id) % 10 when 0 then 'FAILED' when 1 then 'AMBIGUOUS' else 'COMPLETED' end as state, case h('co:' || pass_id) % 4 when 0 then 'ANSWER_A' when 1 then 'ANSWER_B' when 2 then 'TIE' end as final_outcome from ledger where classification = 'CORRECTED_RERUN_REQUIRED'",
    "recovery": "select planned_pass_id as original_planned_pass_id, 'r:' || planned_pass_id as planned_pass_id, case h('rs:' || planned_pass_id) % 5 when 0 then 'FAILED' else 'COMPLETED' end as state, case h('ro:' || planned_pass_id) % 3 when 0 then 'ANSWER_A' when 1 then 'ANSWER_B' else 'TIE' end as final_outcome from corrected where state <> 'COMPLETED' and h('rx:' || planned_pass_id) % 3 > 0",
    "linked": """select case pair_id % 6 when 0 then 'RQ1' when 1 then 'RQ3' when 2 then 'RQ4' when 3 then 'RQ5' else 'RQ7_PRIMARY' end as rq_code, s || ':' || judge as unit_id, s as pairing_key, judge, 'DUAL_SWAP' as condition_code, 0.0 as temperature, 1.0 as top_p, presentation, outcome
      from passes where pair_id % 6 < 5 and not (presentation = 'BA' and (pair_id % 6 = 0 or pair_id % 30 in (1, 2, 4)))
      union all select 'RQ7_PRIMARY', p.s || ':' || b.judge || ':base', p.s, b.judge, 'BASELINE_STANDARD', 0.0, 1.0, 'AB', b.baseline_label from baseline b join pairs p on b.pair_id = p.pair_id where p.pair_id % 6 = 4
      union all select 'RQ2', group_key || ':' || cast(repetition_index as string), group_key, judge, 'CONTROL', case when pair_id % 90 = 5 and repetition_index = 0 then 0.7 else 0.0 end, 1.0, 'AB', outcome from repetitions where pair_id % 6 = 5 and not (pair_id % 60 = 11 and repetition_index = 4)""",
    "plan_rows": f"""select cast(pair_id as string) as unit_id, cast(pair_id as string) as pair_key, answer_a_id, case when pair_id % 12 = 5 then answer_a_id else answer_b_id end as answer_b_id, {pick("pair_id % 4", JUDGES)} as judge,
      case when pair_id % 12 = 9 then 'nobody' when pair_id % 4 = 0 then 'openai' else 'openrouter' end as provider, case pair_id % 12 when 0 then 'RQ4' when 1 then 'RQ4' when 2 then 'RQ3' when 3 then 'RQ7' when 4 then 'RQ7' when 8 then 'RQ6' when 10 then 'RQ5' else 'RQ1' end as rq_code,
      case pair_id % 12 when 3 then 'DUAL_SWAP' when 4 then 'BASELINE_STANDARD' when 11 then '' else 'CONTROL' end as condition, case when pair_id % 12 in (0, 1, 10) then 'AB_BA' when pair_id % 12 = 8 then 'SELF_A' else 'AB' end as presentation_order,
      case when pair_id % 12 = 6 then -1 else 0 end as repetition_index, case when pair_id % 12 in (0, 1, 10) then 2 else 1 end as pass_count, case when pair_id % 12 in (0, 10) then 'v' end as variant_checksum, pair_id from pairs""",
    "design_units": f"""select pair_id, {pick("pair_id % 4", JUDGES)} as judge, case pair_id % 3 when 0 then 'VICUNA' when 1 then 'ALPACA' else 'META_LLAMA' end as other_family, category, case when h('ds:' || s) % 2 = 0 then 'SAME' else 'OTHER' end as stratum, answer_a_id, answer_b_id from pairs
      union all select pair_id, {pick("pair_id % 4", JUDGES)}, case pair_id % 3 when 0 then 'VICUNA' when 1 then 'ALPACA' else 'META_LLAMA' end, category, case when h('ds:' || s) % 2 = 0 then 'SAME' else 'OTHER' end, answer_a_id, answer_b_id from pairs where pair_id % 50 = 7""",
    "design_passes": f"""select pair_id, {pick("pair_id % 4", JUDGES)} as judge, presentation, answer_a_id, answer_b_id, case when (presentation = 'AB') or pair_id % 10 = 2 then answer_a_id else answer_b_id end as displayed_a, case when (presentation = 'AB') or pair_id % 10 = 2 then answer_b_id else answer_a_id end as displayed_b,
      case when pair_id % 10 = 3 then 0 else answer_a_id end as same_id from pairs cross join {_ORDERS} where not (presentation = 'BA' and pair_id % 10 = 1)""",
    "variants": """select doc_id, text, judge, s, v, order_no, case when (presentation = 'AB') then 'AB' else 'BA' end as presentation, case when v < 35 then 'ANSWER_A' when v < 70 then 'ANSWER_B' when v < 90 then 'TIE' when v < 95 then 'API_ERROR' end as outcome
      from (select doc_id, text, cast(doc_id as string) as s, judge, presentation, case presentation when 'AB' then 1 else 2 end as order_no, h('v:' || cast(doc_id as string) || ':' || judge || ':' || presentation) % 100 as v
      from documents cross join """ + _JUDGES + " cross join " + _ORDERS + ") x",
}


def needed(query: str) -> list[str]:
    """Names of the tables that a query uses, in order of definition."""
    found: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        for name in TABLES:
            if name not in found and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                found.add(name)
                todo.append(TABLES[name])
    return [n for n in TABLES if n in found]


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that filters take as it is: Spark would move their hashes below the column's own, once for each branch of its CASE, which generated columns keep above."""
    return df.select(*(F.explode(F.array(name)).alias(name) if c == name else c for c in df.columns))


#: What Spark reads in place of a definition: the same rows, with the filtered column generated (see ``once``).
SPARK_TABLES = {"decisions": TABLES["decisions"].replace("from passes where presentation = 'AB' and", "from (select * except (outcome), explode(array(outcome)) as outcome from passes where presentation = 'AB') where")}

SPARK_HASH = r"cast(conv(substr(sha2(\1, 256), 1, 8), 16, 10) as bigint)"
DUCK_HASH = r"cast('0x' || substr(sha256(\1), 1, 8) as bigint)"


def hashed(text: str, form: str) -> str:
    """``h(...)`` written out in an engine's functions (arguments hold balanced parentheses)."""
    out, at = [], 0
    for m in re.finditer(r"(?<![a-z0-9_.])h\(", text):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        out += [text[at : m.start()], form.replace(r"\1", text[m.end() : i - 1])]
        at = i
    return "".join([*out, text[at:]])


#: Tables that others use several times: DuckDB makes them once.
SHARED = ("ledger", "corrected", "recovery")


def duck(query: str) -> str:
    """A DuckDB query over fixture tables, with their definitions in front."""
    names = needed(query)
    ctes = [f"{n} as {'materialized ' if n in SHARED else ''}({TABLES[n]})" for n in names]
    own = re.match(r"\s*with\s+", query, re.I)
    body = query[own.end() :] if own else query
    return hashed(f"with {', '.join(ctes)}{', ' if own else ' '}{body}" if ctes else query, DUCK_HASH)


SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table, or one of the given tables, as a DataFrame."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    query = f"select * from {name}"
    names = needed(query)
    defined = TABLES | SPARK_TABLES
    texts = [defined[n] for n in names]
    used = [s for s in SOURCES if any(re.search(rf"\b(?:from|join)\s+{s}\b", t) for t in texts)]
    # An order becomes dozens of rows: a small file, which one task would read, is dealt to all before.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = {"orders": f"/*+ REPARTITION({parts}) */"}
    ctes = [f"{s} as (select {dealt.get(s, '')} * from parquet.`{sf_dir}/{s}.parquet`)" for s in used] + [f"{n} as ({defined[n]})" for n in names]
    return spark.sql(hashed(f"with {', '.join(ctes)} {query}", SPARK_HASH))
