"""Queries on the driver's tables for every operator, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bridge
from .functions import labels, outline, redaction, values
from .functions.text import word_tokens
from .model import Store
from .operators import entities, episodes, mining, ratings, sequence, statistics, traversal
from .operators.checkpoint import cut, shared_folder
from .plans import compiler, filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def ask(name: str, text: str, sql: str, *columns, store=bridge.chat_store, **options) -> None:
    """Register a search query, returning ids and further columns."""
    query(name, sql)(lambda spark, d: compiler.run(store(spark, d), text, **options).select("id", *columns))


# --------------------------------------------------------------------------- search language
CHAT = "WITH m AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, conv_id::VARCHAR AS s, turn, role, text, lower(text) AS low FROM conversations)"
TALK = "role NOT IN ('system', 'developer')"
ask("q_content_contains", "thand", f"{CHAT} SELECT id FROM m WHERE contains(low, 'thand') AND {TALK}")
ask("q_phrase", '"of the"', f"{CHAT} SELECT id FROM m WHERE contains(low, 'of the') AND {TALK}")
ask("q_regex", "/th(e|at) [a-z]+ing/", f"{CHAT} SELECT id FROM m WHERE regexp_matches(low, 'th(e|at) [a-z]+ing') AND {TALK}")
ask("q_startswith", "message.startswith:the", f"{CHAT} SELECT id FROM m WHERE starts_with(lower(ltrim(text)), 'the')")
ask("q_case_sensitive", "The case:yes", f"{CHAT} SELECT id FROM m WHERE contains(text, 'The') AND {TALK}")
ask("q_role_is", "role:USER", f"{CHAT} SELECT id FROM m WHERE role = 'user'")
ask("q_negated", "-content:thand role:user", f"{CHAT} SELECT id FROM m WHERE NOT (contains(low, 'thand') AND {TALK}) AND role = 'user'")
ask("q_boolean_or_and_not", "(thand or ingth) and not role:assistant", f"{CHAT} SELECT id FROM m WHERE (contains(low, 'thand') OR contains(low, 'ingth')) AND {TALK} AND NOT role = 'assistant'")
ask("q_internal_roles", "thand internal:yes", f"{CHAT} SELECT id FROM m WHERE contains(low, 'thand')")
ask("q_thread_semi", "user:was select:thread", f"{CHAT} SELECT DISTINCT s AS id FROM m WHERE role = 'user' AND contains(low, 'was')")
ask("q_thread_anti", "-user:thand select:thread", f"{CHAT} SELECT DISTINCT s AS id FROM m WHERE s NOT IN (SELECT s FROM m WHERE role = 'user' AND contains(low, 'thand'))")
ask("q_session_multi_term", "user:was assistant:that -message:eaea select:session", f"{CHAT} SELECT s AS id FROM m GROUP BY s HAVING bool_or(role = 'user' AND contains(low, 'was')) AND bool_or(role = 'assistant' AND contains(low, 'that')) AND NOT bool_or(contains(low, 'eaea'))")
ask("q_session_prefix", "session:1 role:system", f"{CHAT} SELECT id FROM m WHERE role = 'system' AND starts_with(s, '1')")
LOG = "WITH e AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS s, ts, event_type, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS status, value, props FROM events), p AS (SELECT s, min(ts) AS started FROM e GROUP BY s)"
ask("q_after_before", "after:2024-01-01T06:00:00 before:2024-01-02 select:session", f"{LOG} SELECT s AS id FROM p WHERE started >= TIMESTAMP '2024-01-01 06:00:00' AND started < TIMESTAMP '2024-01-02'", store=bridge.log_store)
ask("q_count_limit", "select:session count:5", f"{LOG} SELECT s AS id FROM p ORDER BY started DESC, s LIMIT 5", store=bridge.log_store)
ask("q_status_action", "status:success action:log.click", f"{LOG} SELECT id FROM e WHERE status = 'success' AND event_type = 'click'", store=bridge.log_store)
ask("q_tool_or_session", "tool:purchase or session.is:7", f"{LOG} SELECT id FROM e WHERE event_type = 'purchase' OR starts_with(s, '7')", store=bridge.log_store)


def judged_store(spark: SparkSession, d: str) -> Store:
    """The log in three folders, later users as children of earlier ones, large values tagged, every fourth user reflected
    on with three ratings."""
    e, u = bridge.read(spark, d, "events"), F.col("user_id")
    events = bridge.actions(spark, d).withColumn("cwd", F.concat(F.lit("/w/p"), (F.col("session_id").cast("int") % 3).cast("string"), F.lit("/src")))
    events = events.withColumn("parent_run_id", F.when(F.col("session_id").cast("int") > 75, (F.col("session_id").cast("int") - 75).cast("string")))
    tags = e.where("value > 100").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("value") > 200, "big:gold").otherwise("big").alias("tag"), F.lit(None).cast("string").alias("ref"))
    text = lambda c: c.cast("string")
    r = e.select("user_id").distinct().where("user_id % 4 = 0").select(F.concat(F.lit("r"), text(u)).alias("id"), text(u).alias("session_id"), text(u).alias("thread_id"), F.lit("2024-02-01T00:00:00Z").alias("at"), F.when(u % 8 == 0, "judge").otherwise("coach").alias("prompt_name"), text(u % 3).alias("prompt_version"), F.concat(F.lit("p_"), F.lpad(text(u), 4, "0")).alias("prompt_hash"), F.lit("s1").alias("schema_hash"), F.concat(F.lit("a"), text(u % 5)).alias("asked"), F.concat(F.lit("rev"), F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("@"), text(u % 3)))).alias("revision"), F.when(u % 12 == 0, "handoff").otherwise("attached").alias("mode"), F.lit("After a Failure").alias("trigger"), F.lit("claude").alias("reflector_harness"), F.lit("m1").alias("model"))
    what = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(scale).alias("scale"), rating.alias("rating")) for t, scale, rating in (("skill:review", "quality", F.when(F.col("session_id").cast("int") % 16 == 0, "good").otherwise("bad")), ("skill_file:deploy/run.sh", "quality", F.lit("good")), ("hook:stop", "failure", F.when(F.col("session_id").cast("int") % 5 == 0, "loop").otherwise("none")))))
    ratings_ = r.select(F.col("id").alias("reflection_id"), F.explode(what).alias("x")).select("reflection_id", F.lit("i").alias("item"), F.lit(None).cast("string").alias("ref"), "x.target", "x.scale", "x.rating")
    return Store.of(events, tags=tags, reflections=r, ratings=ratings_)


USERS = "WITH u AS (SELECT DISTINCT user_id AS u FROM events), r AS (SELECT u, 'r' || u::VARCHAR AS id FROM u WHERE u % 4 = 0)"
for _name, _text, _sql in (
        ("q_tag", "tag:big", "SELECT event_id::VARCHAR AS id FROM events WHERE value > 100"),
        ("q_tag_below", "tag:big:gold -role:user", "SELECT event_id::VARCHAR AS id FROM events WHERE value > 200"),
        ("q_cwd", "cwd:/w/p1 select:session", f"{USERS} SELECT u::VARCHAR AS id FROM u WHERE u % 3 = 1"),
        ("q_at_child", "at:child select:thread", f"{USERS} SELECT u::VARCHAR AS id FROM u WHERE u > 75"),
        ("q_family", "(family:3 or family:80) select:thread", f"{USERS} SELECT u::VARCHAR AS id FROM u WHERE starts_with((CASE WHEN u > 75 THEN u - 75 ELSE u END)::VARCHAR, '3') OR u IN (5, 80)"),
        ("q_reflected", "reflected:no cwd:/w select:session", f"{USERS} SELECT u::VARCHAR AS id FROM u WHERE u % 4 <> 0"),
        ("q_prompt", "prompt:judge@1 select:reflection", f"{USERS} SELECT id FROM r WHERE u % 8 = 0 AND u % 3 = 1"),
        ("q_prompt_hash", "prompt:p_00 trigger:failure select:reflection", f"{USERS} SELECT id FROM r WHERE u < 100"),
        ("q_revision", "revision:rev -mode:handoff select:reflection", f"{USERS} SELECT id FROM r WHERE u % 12 <> 0"),
        ("q_revision_version", "revision:rev@2 asked:a1 select:session", f"{USERS} SELECT u::VARCHAR AS id FROM r WHERE u % 3 = 2 AND u % 5 = 1"),
        ("q_target_rated", "target:skill:review rated:good select:reflection", f"{USERS} SELECT id FROM r WHERE u % 16 = 0"),
        ("q_target_skill_file", "target:skill:deploy select:session", f"{USERS} SELECT u::VARCHAR AS id FROM r"),
        ("q_failure", "failure:loop select:session", f"{USERS} SELECT u::VARCHAR AS id FROM r WHERE u % 5 = 0")):
    ask(_name, _text, _sql, store=judged_store)


@query("q_match_ranges", f"{CHAT}, k AS (SELECT id, low, unnest(range(1, len(low) - 3)) AS i FROM m WHERE contains(low, 'thand') AND {TALK}) SELECT id, string_agg((i - 1)::VARCHAR || '-' || (i + 4)::VARCHAR, ',' ORDER BY i) AS ranges FROM k WHERE substr(low, i, 5) = 'thand' GROUP BY id")
def match_ranges(spark, d):
    rows = compiler.run(bridge.chat_store(spark, d), "thand")
    spans = F.transform(compiler.match_ranges("thand", F.col("text")), lambda r: F.concat_ws("-", r["start"], r["end"]))
    return rows.select("id", F.array_join(spans, ",").alias("ranges"))


@query("q_lexical_bm25", r"""WITH m AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations WHERE role NOT IN ('system', 'developer')),
a AS (SELECT list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
f AS (SELECT count(*) AS n, avg(len(w)) AS mean, count(*) FILTER (list_contains(w, 'retion')) AS df FROM a),
t AS (SELECT id, len(list_filter(w, lambda x: x = 'retion')) AS tf, len(w) AS size FROM m WHERE list_contains(w, 'retion'))
SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score FROM t, f""")
def lexical(spark, d):
    return compiler.run(bridge.chat_store(spark, d), "patterntype:lexical retion").select("id", F.round("score", 6).alias("score"))


# --------------------------------------------------------------------------- joins
@query("j_first_match_lookup", f"{LOG} SELECT s AS session_id, first(id ORDER BY ts, id) AS first_error, count(*) AS errors FROM e WHERE status = 'failure' GROUP BY s")
def first_match(spark, d):
    e = bridge.actions(spark, d).where("status = 'failure'")
    return e.groupBy("session_id").agg(F.min_by("id", F.struct("byte_offset", "id")).alias("first_error"), F.count("*").alias("errors"))


@query("j_call_result_pairing", f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, id) - 1 AS i FROM e), k AS (SELECT s, i AS call, i + 1 AS result FROM r WHERE i % 2 = 0) SELECT k.s AS session_id, k.call, r.i AS result, r.status FROM k LEFT JOIN r ON r.s = k.s AND r.i = k.result")
def pairing(spark, d):
    """Every even step as a call, every odd one as its result."""
    e = sequence.positions(bridge.actions(spark, d))
    even = F.col("i") % 2 == 0
    calls = e.withColumn("kind", F.when(even, "tool_call").otherwise("tool_result")).withColumn("call_id", F.floor(F.col("i") / 2).cast("string"))
    return sequence.call_results(calls.drop("i")).select("session_id", F.col("call").cast("bigint").alias("call"), F.col("result").cast("bigint").alias("result"), "status")


@query("j_existence_under_or", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def existence(spark, d):
    flags = bridge.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    return bridge.read(spark, d, "customer").join(flags, "c_custkey", "left").where("p OR p IS NULL").select("c_custkey")


@query("j_unique_pairs", "WITH a AS (SELECT floor(c_acctbal / 5)::BIGINT AS k, min(c_custkey) AS a FROM customer GROUP BY 1 HAVING count(*) = 1), b AS (SELECT floor(s_acctbal / 5)::BIGINT AS k, min(s_suppkey) AS b FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT k, a, b FROM a JOIN b USING (k)")
def unique_pairs(spark, d):
    """Keys that occur exactly once on both sides."""
    once = lambda t, k, v, n: bridge.read(spark, d, t).groupBy(F.floor(F.col(k) / 5).alias("k")).agg(F.min(v).alias(n), F.count("*").alias("c")).where("c = 1").drop("c")
    return once("customer", "c_acctbal", "c_custkey", "a").join(once("supplier", "s_acctbal", "s_suppkey", "b"), "k")


@query("j_asof_model_in_force", f"{LOG} SELECT id, last_value(CASE WHEN event_type = 'signup' THEN id END IGNORE NULLS) OVER (PARTITION BY s ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS in_force FROM e")
def in_force(spark, d):
    e = bridge.actions(spark, d)
    w = sequence.stream().rowsBetween(Window.unboundedPreceding, 0)
    return e.select("id", F.last(F.when(F.col("tool_name") == "signup", F.col("id")), ignorenulls=True).over(w).alias("in_force"))


@query("j_interval", f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, id) - 1 AS i FROM e), f AS (SELECT s, i AS a, i + 4 AS b FROM r WHERE status = 'failure') SELECT r.s AS session_id, r.i, count(*) AS spans FROM r JOIN f ON f.s = r.s AND r.i >= f.a AND r.i < f.b GROUP BY 1, 2")
def interval(spark, d):
    """Steps within four of a failure: the spans are exploded, so the join is an equality."""
    e = sequence.positions(bridge.actions(spark, d))
    inside = e.where("status = 'failure'").select("session_id", F.explode(F.sequence(F.col("i"), F.col("i") + 3)).alias("i"))
    return e.select("session_id", "i").join(inside, ["session_id", "i"]).groupBy("session_id", F.col("i").cast("bigint").alias("i")).agg(F.count("*").alias("spans"))


# --------------------------------------------------------------------------- projections and aggregates
@query("a_session_projection", f"{LOG} SELECT s AS id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS event_count, 1::BIGINT AS run_count FROM e GROUP BY s")
def session_projection(spark, d):
    return bridge.log_store(spark, d).sessions.select("id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "event_count", "run_count")


@query("a_run_projection", f"{CHAT} SELECT s AS id, s AS session_id, count(*) AS event_count FROM m GROUP BY s")
def run_projection(spark, d):
    return bridge.chat_store(spark, d).runs.select("id", "session_id", "event_count")


DAY = """WITH d AS (SELECT user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS case_id, event_id, event_type AS name, ts, value FROM events),
c AS (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY case_id ORDER BY ts, event_id) = name THEN 0 ELSE 1 END AS f FROM d),
g AS (SELECT *, sum(f) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM c),
s AS (SELECT case_id, pos, min(name) AS name, count(*) AS repeat FROM g GROUP BY case_id, pos),
o AS (SELECT case_id, CASE last(name ORDER BY ts, event_id) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'abandoned' END AS outcome FROM d GROUP BY case_id),
q AS (SELECT case_id, outcome, list_concat(['START'], list(name ORDER BY pos), ['END:' || outcome]) AS names, list(repeat ORDER BY pos) AS repeats FROM s JOIN o USING (case_id) GROUP BY case_id, outcome),
i AS (SELECT *, unnest(range(1, len(names))) AS k FROM q),
t AS (SELECT case_id, outcome, k - 1 AS pos, names[k] AS source, names[k + 1] AS target, list_contains(names[1:k], names[k + 1]) AS back FROM i)"""


def day_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    steps = bridge.day_sequences(spark, d)
    last = F.max_by("name", F.struct("ts", "pos"))
    outcomes = steps.groupBy("case_id").agg(F.when(last == "purchase", "completed").when(last == "error", "error").otherwise("abandoned").alias("outcome"))
    return mining.collapse(steps, order=("ts", "pos")), outcomes


def day_cases(spark: SparkSession, d: str) -> DataFrame:
    return mining.sequences(*day_states(spark, d))


@query("s_state_collapse", f"{DAY} SELECT case_id, pos::BIGINT AS pos, name, repeat FROM s")
def state_collapse(spark, d):
    return day_states(spark, d)[0].select("case_id", F.col("pos").cast("bigint").alias("pos"), "name", "repeat")


@query("s_tail_k", f"{DAY} SELECT case_id, pos::BIGINT AS pos, coalesce(lag(name) OVER (PARTITION BY case_id ORDER BY pos) || ' > ', '') || name AS name FROM s")
def tail_k(spark, d):
    return mining.tails(day_states(spark, d)[0], 2).select("case_id", F.col("pos").cast("bigint").alias("pos"), "name")


@query("a_variants", f"{DAY}, v AS (SELECT names, count(*) AS cases FROM q GROUP BY names), r AS (SELECT *, row_number() OVER (ORDER BY cases DESC, names) AS rank, sum(cases) OVER () AS total FROM v) SELECT array_to_string(names, ' > ') AS variant, cases, rank, round(cases / total, 6) AS share, round(sum(cases) OVER (ORDER BY rank) / total, 6) AS cumulative FROM r QUALIFY rank <= 15")
def variants(spark, d):
    v = mining.variants(day_cases(spark, d))
    return v.select(F.array_join("names", " > ").alias("variant"), "cases", F.col("rank").cast("bigint").alias("rank"), F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("a_state_nodes", f"{DAY}, n AS (SELECT case_id, unnest(names) AS name, unnest(list_concat([NULL], repeats, [NULL])) AS repeat FROM q) SELECT name, count(*) AS visits, count(DISTINCT case_id) AS cases, round(avg(repeat), 6) AS mean_repeat FROM n GROUP BY name")
def state_nodes(spark, d):
    return mining.nodes(day_cases(spark, d)).withColumn("mean_repeat", F.round("mean_repeat", 6))


@query("a_state_edges", f"{DAY}, c2 AS (SELECT source, target, case_id, count(*) AS n, sum(back::INT) AS back, max((outcome = 'completed')::INT) AS ok FROM t GROUP BY ALL), x AS (SELECT source, target, sum(n)::BIGINT AS count, avg(ok) AS success_rate, sum(back) AS back FROM c2 GROUP BY ALL) SELECT source, target, count, round(count / sum(count) OVER (PARTITION BY source), 6) AS probability, round(success_rate, 6) AS success_rate, back * 2 > count AS loop_back FROM x")
def state_edges(spark, d):
    return mining.edges(day_cases(spark, d)).select("source", "target", "count", F.round("probability", 6).alias("probability"), F.round("success_rate", 6).alias("success_rate"), "loop_back")


@query("a_weighted_activities", f"{DAY} SELECT name, count(*) AS occurrences, count(DISTINCT case_id) AS cases FROM d GROUP BY name")
def activities(spark, d):
    return mining.weighted_ngrams(bridge.day_sequences(spark, d), 1, order=("ts", "pos")).select(F.col("gram")[0].alias("name"), "occurrences", "cases")


for _n, _name in ((2, "bigrams"), (3, "trigrams")):
    query(f"a_weighted_{_name}", f"{DAY}, w AS (SELECT case_id, name {''.join(f" || ' > ' || lead(name, {k}) OVER (PARTITION BY case_id ORDER BY ts, event_id)" for k in range(1, _n))} AS gram FROM d) SELECT gram, count(*) AS occurrences, count(DISTINCT case_id) AS cases FROM w WHERE gram IS NOT NULL GROUP BY gram")(
        lambda spark, d, n=_n: mining.weighted_ngrams(bridge.day_sequences(spark, d), n, order=("ts", "pos")).select(F.array_join("gram", " > ").alias("gram"), "occurrences", "cases"))

ENTROPY = ", x AS (SELECT source, target, CASE outcome WHEN 'completed' THEN 'c' ELSE 'f' END AS side, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT source, target, sum(n) AS n FROM x GROUP BY ALL), h AS (SELECT source, -sum(p * log2(p)) AS h, count(*) AS successors FROM (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM w) GROUP BY source), hs AS (SELECT source, side, -sum(p * log2(p)) AS h FROM (SELECT source, side, n / sum(n) OVER (PARTITION BY source, side) AS p FROM x) GROUP BY source, side), v AS (SELECT name, count(*) AS visits FROM (SELECT unnest(names) AS name FROM q) GROUP BY name)"


@query("a_branching_entropy", f"{DAY}{ENTROPY} SELECT h.source AS state, visits, round(h.h, 6) + 0 AS entropy, round(coalesce((SELECT h FROM hs WHERE hs.source = h.source AND side = 'c'), 0), 6) + 0 AS entropy_completed, round(coalesce((SELECT h FROM hs WHERE hs.source = h.source AND side = 'f'), 0), 6) + 0 AS entropy_failed, successors FROM h JOIN v ON v.name = h.source")
def branching_entropy(spark, d):
    r = lambda c: (F.round(c, 6) + 0).alias(c)
    return mining.branching_entropy(day_cases(spark, d)).select("state", "visits", r("entropy"), r("entropy_completed"), r("entropy_failed"), "successors")


@query("a_contrast_log_odds", f"""{DAY}, f AS (SELECT case_id, outcome <> 'completed' AS g, n, unnest(range(1, len(names) - n + 2)) AS k, names FROM q, (SELECT unnest([1, 2, 3]) AS n)),
p AS (SELECT DISTINCT case_id, g, array_to_string(names[k : k + n - 1], ' > ') AS pattern FROM f), z AS (SELECT count(*) FILTER (outcome <> 'completed') AS "A", count(*) FILTER (outcome = 'completed') AS "B" FROM q),
c3 AS (SELECT pattern, count(*) FILTER (g) AS a_, count(*) FILTER (NOT g) AS b_ FROM p GROUP BY pattern HAVING count(*) >= 5)
SELECT pattern, a_ AS a, b_ AS b, round(ln((a_ + 0.5) / ("A" - a_ + 0.5)) - ln((b_ + 0.5) / ("B" - b_ + 0.5)), 6) AS log_odds, round((a_ / "A") / ((a_ + b_) / ("A" + "B")), 6) AS lift FROM c3, z""")
def contrast(spark, d):
    c = mining.contrast(day_cases(spark, d), F.col("outcome") != "completed")
    return c.select(F.array_join("pattern", " > ").alias("pattern"), "a", "b", F.round("log_odds", 6).alias("log_odds"), F.round("lift", 6).alias("lift"))


@query("a_interventions", f"{DAY}, v AS (SELECT name, count(*) AS visits FROM (SELECT unnest(names) AS name FROM q) GROUP BY name) SELECT source AS state, target AS intervention, count(*) AS count, round(count(*) / any_value(visits), 6) AS rate FROM t JOIN v ON v.name = source WHERE target IN ('error', 'signup') GROUP BY ALL")
def interventions(spark, d):
    return mining.interventions(day_cases(spark, d), ("error", "signup")).select("state", "intervention", "count", F.round("rate", 6).alias("rate"))


@query("a_failure_sinks", f"""{DAY}, r AS (SELECT *, len(names) - 2 AS n, (outcome = 'completed')::INT AS ok FROM q), l AS (SELECT list(n ORDER BY n) AS l, count(*) AS total FROM r),
k AS (SELECT r.*, (n > l[1 + floor(total * 0.25)::INT])::INT + (n > l[1 + floor(total * 0.5)::INT])::INT + (n > l[1 + floor(total * 0.75)::INT])::INT AS stratum FROM r, l),
st AS (SELECT stratum, count(*) AS total_n, sum(ok) AS total_s FROM k GROUP BY stratum), u AS (SELECT DISTINCT case_id, stratum, ok, unnest(names[2:-2]) AS state FROM k),
th AS (SELECT state, stratum, count(*) AS kk, sum(ok) AS s FROM u GROUP BY ALL), ag AS (SELECT state, sum(kk)::BIGINT AS cases, sum(s) AS done, sum(CASE WHEN total_n > kk THEN (s / kk - (total_s - s) / (total_n - kk)) * kk END) / sum(CASE WHEN total_n > kk THEN kk END) AS adj FROM th JOIN st USING (stratum) GROUP BY state HAVING sum(kk) >= 5),
la AS (SELECT names[-2] AS state, count(*) AS last FROM k WHERE ok = 0 GROUP BY 1), b AS (SELECT avg(ok) AS baseline, count(*) FILTER (ok = 0) AS failed FROM k)
SELECT state, cases, round(done / cases, 6) AS completed, round(baseline, 6) AS baseline, round(done / cases - baseline, 6) AS delta, round(adj, 6) AS adjusted_delta, coalesce(last, 0) AS last_in_failed, round(coalesce(last, 0) / failed, 6) AS last_share FROM ag LEFT JOIN la USING (state), b""")
def failure_sinks(spark, d):
    rounded = ("completed", "baseline", "delta", "adjusted_delta", "last_share")
    return mining.failure_sinks(day_cases(spark, d)).select("state", "cases", "last_in_failed", *(F.round(c, 6).alias(c) for c in rounded))


@query("a_cost_hotspots", f"{DAY} SELECT name AS state, round(sum(value), 4) AS cost, round(sum(value) / sum(sum(value)) OVER (), 6) AS share, round(sum(value) / count(DISTINCT (case_id, pos)), 6) AS per_visit FROM g GROUP BY name")
def cost_hotspots(spark, d):
    out = entities.cost_hotspots(bridge.day_sequences(spark, d), order=("ts", "pos"), cost="value")
    return out.select("state", F.round("cost", 4).alias("cost"), F.round("share", 6).alias("share"), F.round("per_visit", 6).alias("per_visit"))


LOOPED = "l AS (SELECT s.case_id, pos, name, outcome <> 'completed' AS failed FROM s JOIN o USING (case_id) WHERE repeat >= 2)"
MONTH = "substr(split_part(case_id, ':', 2), 1, 7)"


@query("a_drift_month", f"{DAY}, {LOOPED}, v AS (SELECT {MONTH} AS key, name, count(*) AS n FROM s GROUP BY ALL), top AS (SELECT key, string_agg(name, ',' ORDER BY n DESC, name) AS top_states FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, name) AS r FROM v) WHERE r <= 3 GROUP BY key) SELECT {MONTH} AS key, count(*) AS cases, round(avg((outcome = 'completed')::INT), 6) AS completed, median(len(names) - 2) AS median_states, round(avg((case_id IN (SELECT case_id FROM l))::INT), 6) AS loop_share, any_value(top_states) AS top_states FROM q JOIN top ON key = {MONTH} GROUP BY 1")
def drift(spark, d):
    cases = day_cases(spark, d)
    out = entities.drift(cases, values.month(F.split_part("case_id", F.lit(":"), F.lit(2))), mining.self_loops(cases))
    return out.select("key", "cases", F.round("completed", 6).alias("completed"), "median_states", F.round("loop_share", 6).alias("loop_share"), F.array_join("top_states", ",").alias("top_states"))


def _user(case="case_id"):
    return F.split_part(case, F.lit(":"), F.lit(1)).cast("int")


@query("a_drift_by", f"{DAY}, {LOOPED}, m AS (SELECT name FROM l GROUP BY name ORDER BY count(*) DESC, name LIMIT 4), k AS (SELECT (split_part(case_id, ':', 1)::INT % 5)::VARCHAR AS key, case_id, outcome FROM o) SELECT k.key, m.name AS mode, count(*) AS cases, round(avg((outcome = 'completed')::INT), 6) AS completed, round(avg(((k.case_id, m.name) IN (SELECT (case_id, name) FROM l))::INT), 6) AS share FROM k, m GROUP BY ALL")
def drift_by(spark, d):
    """Days by group of users; a state that repeats is a finding of its name."""
    cases = day_cases(spark, d)
    found = mining.self_loops(cases).select("case_id", F.col("cycle")[0].alias("mode"))
    out = entities.drift_by(cases, found, (_user() % 5).cast("string"))
    return out.withColumn("completed", F.round("completed", 6)).withColumn("share", F.round("share", 6))


@query("a_counters", f"{DAY}, {LOOPED} SELECT (SELECT count(*) FROM q) AS cases, (SELECT count(*) FROM s) AS states, (SELECT count(*) FROM o WHERE outcome = 'completed') AS completed, (SELECT count(DISTINCT name) FROM s) AS labels, (SELECT count(*) FROM l) AS loops")
def counters(spark, d):
    cases = day_cases(spark, d)
    return entities.counters(cases, mining.self_loops(cases))


def day_links(spark: SparkSession, d: str) -> DataFrame:
    """What each step of a day touches: its type as a tool, one of forty files, and its user's model of three."""
    steps, w = bridge.day_sequences(spark, d), Window.partitionBy("case_id").orderBy("ts", "pos")
    fresh = F.when(F.lag("name").over(w) == F.col("name"), 0).otherwise(1)
    at = steps.withColumn("fresh", fresh).withColumn("state", (F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    model = F.concat(F.lit("m"), (_user() % 3).cast("string"))
    file = F.concat(F.lit("f"), (F.col("pos") % 40).cast("string"))
    kinds = F.array(F.struct(F.lit("tool").alias("kind"), F.col("name").alias("entity")), F.struct(F.lit("file").alias("kind"), file.alias("entity")), F.struct(F.lit("model").alias("kind"), model.alias("entity")))
    return at.select("case_id", "state", F.explode(kinds).alias("x"), F.when(F.col("name") == "click", "EDIT").otherwise("READ").alias("action"), (F.col("name") == "error").alias("failed")).select("case_id", "state", "x.kind", "x.entity", "action", "failed")


FAILING = f"{LOOPED}, bad AS (SELECT case_id, pos FROM l WHERE failed)"


@query("a_entity_edit_hotspots", "SELECT 'f' || (event_id % 40)::VARCHAR AS file, count(*) AS edits, count(DISTINCT user_id) AS sessions FROM events WHERE event_type = 'click' GROUP BY 1")
def edit_hotspots(spark, d):
    return entities.edit_hotspots(day_links(spark, d), day_cases(spark, d).select("case_id", _user().alias("session_id")))


@query("a_entity_loop_files", f"{DAY}, {FAILING} SELECT 'f' || (event_id % 40)::VARCHAR AS file, count(*) AS steps, count(DISTINCT case_id) AS cases FROM g JOIN bad USING (case_id, pos) GROUP BY 1")
def loop_files(spark, d):
    return entities.loop_files(day_links(spark, d), mining.self_loops(day_cases(spark, d)))


@query("a_entity_model_tools", f"{DAY}, {FAILING} SELECT 'm' || (split_part(case_id, ':', 1)::INT % 3)::VARCHAR AS model, name AS tool, count(*) AS calls, round(avg((name = 'error')::INT), 6) AS fail_rate, round(avg(((case_id, pos) IN (SELECT (case_id, pos) FROM bad))::INT), 6) AS in_failure_loops FROM g GROUP BY ALL HAVING count(*) >= 5")
def model_tools(spark, d):
    out = entities.model_tools(day_links(spark, d), mining.self_loops(day_cases(spark, d)))
    return out.withColumn("fail_rate", F.round("fail_rate", 6)).withColumn("in_failure_loops", F.round("in_failure_loops", 6))


@query("a_entity_projects", f"{DAY} SELECT 'p' || (split_part(case_id, ':', 1)::INT % 7)::VARCHAR AS project, count(*) AS cases, round(avg((outcome = 'completed')::INT), 6) AS completed FROM q GROUP BY 1 HAVING count(*) >= 2")
def entity_projects(spark, d):
    cases = day_cases(spark, d).withColumn("cwd", F.concat(F.lit("p"), (_user() % 7).cast("string")))
    return entities.projects(cases).withColumn("completed", F.round("completed", 6))


@query("s_loops_self", f"{DAY} SELECT case_id, name AS state, repeat AS iterations, pos::BIGINT AS start FROM s WHERE repeat >= 2")
def loops_self(spark, d):
    return mining.self_loops(day_cases(spark, d)).select("case_id", F.col("cycle")[0].alias("state"), "iterations", "start")


@query("s_loops_cycle")
def loops_cycle(spark, d):
    return mining.cycles(day_cases(spark, d)).withColumn("cycle", F.array_join("cycle", " > "))


@query("a_loop_table")
def loop_table(spark, d):
    cases = day_cases(spark, d)
    return mining.loop_table(mining.self_loops(cases).unionByName(mining.cycles(cases))).withColumn("cycle", F.array_join("cycle", " > "))


@query("s_prefixspan")
def prefixspan(spark, d):
    return mining.closed(mining.prefixspan(day_cases(spark, d))).withColumn("pattern", F.array_join("pattern", " > "))


@query("r_happy_path", f"{DAY.replace('WITH', 'WITH RECURSIVE', 1)}, step AS (SELECT source, target, count(*) AS n FROM t GROUP BY ALL), arc AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS p FROM step), path AS (SELECT ['START'] AS p, 1.0::DOUBLE AS pr, 'START' AS here UNION ALL SELECT list_append(path.p, arc.target), pr * arc.p, arc.target FROM path JOIN arc ON arc.source = here WHERE NOT list_contains(path.p, arc.target) AND here <> 'END:completed') SELECT array_to_string(p, ' > ') AS path, round(pr, 9) AS probability FROM path WHERE here = 'END:completed' ORDER BY pr DESC LIMIT 1")
def happy_path(spark, d):
    path, p = traversal.happy_path(mining.edges(day_cases(spark, d)))
    return spark.createDataFrame([(" > ".join(path), round(p, 9))], "path string, probability double")


# --------------------------------------------------------------------------- sequences
@query("s_trajectories", f"{CHAT}, t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY s ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n, sum((role = 'user')::INT) OVER (PARTITION BY s) AS of FROM m) SELECT id, CASE WHEN n > 0 THEN n::BIGINT END AS trajectory, CASE WHEN n = 0 THEN NULL WHEN n < of THEN 'next_prompt' ELSE 'end_of_stream' END AS boundary FROM t")
def trajectories(spark, d):
    return sequence.trajectories(bridge.messages(spark, d)).select("id", "trajectory", "boundary")


@query("s_frustration_spike", f"{LOG}, r AS (SELECT *, row_number() OVER w - 1 AS i, sum((status = 'failure')::INT) OVER (PARTITION BY s ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS bad, count(*) OVER (PARTITION BY s ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM e WINDOW w AS (PARTITION BY s ORDER BY ts, id)) SELECT s AS session_id, i AS start, i + 4 AS \"end\", bad::VARCHAR AS detail FROM r WHERE n = 5 AND bad >= 3")
def frustration(spark, d):
    return sequence.FrustrationSpike().matches(bridge.actions(spark, d)).select("session_id", "start", "end", "detail")


@query("s_long_silence", f"{LOG}, r AS (SELECT *, row_number() OVER w - 1 AS i, sum((event_type = 'signup')::INT) OVER (PARTITION BY s ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS g FROM e WINDOW w AS (PARTITION BY s ORDER BY ts, id)), k AS (SELECT s, g, min(i) AS a, max(i) AS b, count(*) AS n FROM r WHERE event_type <> 'signup' GROUP BY s, g) SELECT s AS session_id, a AS start, b AS \"end\", n::VARCHAR AS detail FROM k WHERE n >= 8")
def silence(spark, d):
    e = bridge.actions(spark, d).withColumn("role", F.when(F.col("tool_name") == "signup", "user").otherwise("tool"))
    return sequence.LongSilence().matches(e).select("session_id", "start", "end", "detail")


def _as_calls(spark: SparkSession, d: str) -> DataFrame:
    """The log with views as calls, errors as their failed results, clicks as writes and the rest as messages."""
    e, kind = bridge.actions(spark, d), F.col("tool_name")
    return e.withColumn("kind", F.when(kind.isin("view", "click"), "tool_call").when(kind == "error", "tool_result").otherwise("message")).withColumn("role", F.when(kind == "signup", "user").when(kind == "purchase", "assistant").otherwise("tool")).withColumn("tool_name", F.when(kind == "view", "view").when(kind == "click", "edit_file")).withColumn("arguments", F.concat(F.lit('{"path": "'), (F.get_json_object("arguments", "$.k").cast("int") % 2).cast("string"), F.lit('"}')))


CALLS = f"{LOG}, k AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'tool_call' WHEN event_type = 'error' THEN 'tool_result' ELSE 'message' END AS kind, CASE event_type WHEN 'signup' THEN 'user' WHEN 'purchase' THEN 'assistant' ELSE 'tool' END AS role, (json_extract(props, '$.k')::INT % 2)::VARCHAR AS file FROM e), n AS (SELECT *, row_number() OVER w - 1 AS i, lead(event_type, 1) OVER w AS e1, lead(event_type, 2) OVER w AS e2 FROM k WINDOW w AS (PARTITION BY s ORDER BY ts, id))"


#: What each pattern finds in CALLS: s, a, b, detail.
PIECES = """stub AS (SELECT s, i AS a, i + 2 AS b, CASE event_type WHEN 'view' THEN 'view' ELSE 'edit_file' END AS detail FROM n WHERE kind = 'tool_call' AND e1 = 'error' AND e2 = event_type),
spike AS (SELECT s, i AS a, i + 4 AS b, bad::VARCHAR AS detail FROM (SELECT s, i, sum((status = 'failure')::INT) OVER w AS bad, count(*) OVER w AS size FROM n WINDOW w AS (PARTITION BY s ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE size = 5 AND bad >= 3),
f AS (SELECT *, CASE WHEN event_type = 'click' THEN file END AS target FROM n WHERE kind <> 'tool_result'), g AS (SELECT *, CASE WHEN target IS NOT NULL AND lag(target) OVER w = target THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY s ORDER BY i)), h AS (SELECT *, sum(fresh) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM g), x AS (SELECT s, g, any_value(target) AS target, min(i) AS a, count(*) AS n FROM h GROUP BY s, g), y AS (SELECT *, lead(a) OVER (PARTITION BY s ORDER BY g) AS nxt FROM x), z AS (SELECT s, max(i) AS last FROM n GROUP BY s),
overwrite AS (SELECT s, a, coalesce(nxt - 1, last) AS b, target AS detail FROM y JOIN z USING (s) WHERE target IS NOT NULL AND n >= 2),
fix AS (SELECT a.s, a.i AS a, min(b.i) FILTER (b.event_type = 'click' AND b.file <> a.file) AS b, any_value(a.file) AS detail, coalesce(bool_or(b.kind = 'tool_call' AND b.file = a.file), false) AS back FROM n a LEFT JOIN n b ON a.s = b.s AND b.i BETWEEN a.i + 2 AND a.i + 11 WHERE a.event_type = 'click' AND a.e1 = 'error' GROUP BY a.s, a.i),
abandoned AS (SELECT s, a, b, detail FROM fix WHERE NOT back AND b IS NOT NULL),
ask AS (SELECT a.s, a.i, min(b.i) FILTER (b.role IN ('user', 'assistant')) AS stop, min(b.i) FILTER (b.kind = 'tool_call') AS call, max(b.i) AS seen, min(b.i) FILTER (b.role = 'assistant') AS speech FROM n a LEFT JOIN n b ON a.s = b.s AND b.i BETWEEN a.i + 1 AND a.i + 5 WHERE a.role = 'user' GROUP BY a.s, a.i),
ignored AS (SELECT s, i AS a, coalesce(stop, seen) AS b FROM ask WHERE call <= coalesce(stop, seen) AND (speech IS NULL OR stop IS NULL OR speech <> stop)),
quiet AS (SELECT s, g, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT *, sum((role <> 'tool')::INT) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM n) WHERE role = 'tool' GROUP BY s, g),
silence AS (SELECT s, a, b FROM quiet WHERE n >= 8)"""


@query("s_stubborn_loop", f"{CALLS} SELECT s AS session_id, i AS start, i + 2 AS \"end\", CASE event_type WHEN 'view' THEN 'view' ELSE 'edit_file' END AS detail FROM n WHERE kind = 'tool_call' AND e1 = 'error' AND e2 = event_type")
def stubborn(spark, d):
    return sequence.StubbornToolLoop().matches(_as_calls(spark, d)).select("session_id", "start", "end", "detail")


@query("s_self_overwrite", f"{CALLS}, f AS (SELECT *, CASE WHEN event_type = 'click' THEN file END AS target FROM n WHERE kind <> 'tool_result'), g AS (SELECT *, CASE WHEN target IS NOT NULL AND lag(target) OVER w = target THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY s ORDER BY i)), h AS (SELECT *, sum(fresh) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM g), x AS (SELECT s, g, any_value(target) AS target, min(i) AS a, count(*) AS n FROM h GROUP BY s, g), y AS (SELECT *, lead(a) OVER (PARTITION BY s ORDER BY g) AS nxt FROM x), z AS (SELECT s, max(i) AS last FROM n GROUP BY s) SELECT s AS session_id, a AS start, coalesce(nxt - 1, last) AS \"end\", target AS detail FROM y JOIN z USING (s) WHERE target IS NOT NULL AND n >= 2")
def overwrite(spark, d):
    return sequence.SelfOverwrite().matches(_as_calls(spark, d)).select("session_id", "start", "end", "detail")


@query("s_ignored_user", f"{CALLS}, x AS (SELECT a.s, a.i, min(b.i) FILTER (b.role IN ('user', 'assistant')) AS stop, min(b.i) FILTER (b.kind = 'tool_call') AS call, max(b.i) AS seen, min(b.i) FILTER (b.role = 'assistant') AS speech FROM n a LEFT JOIN n b ON a.s = b.s AND b.i BETWEEN a.i + 1 AND a.i + 5 WHERE a.role = 'user' GROUP BY a.s, a.i) SELECT s AS session_id, i AS start, coalesce(stop, seen) AS \"end\" FROM x WHERE call <= coalesce(stop, seen) AND (speech IS NULL OR stop IS NULL OR speech <> stop)")
def ignored(spark, d):
    return sequence.IgnoredUserInstruction().matches(_as_calls(spark, d)).select("session_id", "start", "end")


@query("s_abandoned_fix", f"{CALLS}, {PIECES} SELECT s AS session_id, a AS start, b AS \"end\", detail FROM abandoned")
def abandoned(spark, d):
    return sequence.AbandonedFix().matches(_as_calls(spark, d)).select("session_id", "start", "end", "detail")


@query("s_empty_result", f"{CALLS} SELECT s AS session_id, i AS start, 'info' AS severity FROM n WHERE event_type = 'error'")
def empty_results(spark, d):
    """Errors of the log, as results whose text is white space."""
    e = _as_calls(spark, d)
    return sequence.EmptyToolResult().matches(e.withColumn("text", F.when(F.col("kind") == "tool_result", F.lit(" \u2003\n")).otherwise(F.col("text")))).select("session_id", "start", "severity")


@query("s_any_of", f"{CALLS}, {PIECES} SELECT 'stubborn_tool_loop' AS pattern, s AS session_id, a AS start, b AS \"end\", detail FROM stub UNION SELECT 'frustration_spike', s, a, b, detail FROM spike")
def any_of(spark, d):
    return (sequence.StubbornToolLoop() | sequence.FrustrationSpike()).matches(_as_calls(spark, d)).select("pattern", "session_id", "start", "end", "detail")


@query("s_all_of_trajectory", f"{CALLS}, {PIECES}, t AS (SELECT s, i, sum((event_type = 'signup')::INT) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM n), every AS (SELECT 1 AS k, s, a, b FROM stub UNION ALL SELECT 2, s, a, b FROM overwrite) SELECT e.s AS session_id, min(a) AS start, max(b) AS \"end\", 'warning' AS severity, x.t::BIGINT::VARCHAR AS detail FROM every e JOIN t x ON x.s = e.s AND x.i = a JOIN t y ON y.s = e.s AND y.i = b WHERE x.t = y.t AND x.t > 0 GROUP BY e.s, x.t HAVING count(DISTINCT k) = 2")
def all_of(spark, d):
    return (sequence.StubbornToolLoop() & sequence.SelfOverwrite()).matches(_as_calls(spark, d)).select("session_id", "start", "end", "severity", "detail")


@query("s_scan_summary", f"{CALLS}, {PIECES}, every AS (SELECT 'stubborn_tool_loop' AS pattern, 'warning' AS severity, s FROM stub UNION ALL SELECT 'frustration_spike', 'warning', s FROM spike UNION ALL SELECT 'self_overwrite', 'warning', s FROM overwrite UNION ALL SELECT 'abandoned_fix', 'warning', s FROM abandoned UNION ALL SELECT 'ignored_user_instruction', 'info', s FROM ignored UNION ALL SELECT 'long_silence', 'info', s FROM silence) SELECT pattern, severity, count(*) AS findings, count(DISTINCT s) AS sessions FROM every GROUP BY ALL")
def scan_summary(spark, d):
    return sequence.summary(sequence.scan(_as_calls(spark, d)))


@query("s_context_window", f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, id) - 1 AS i FROM e) SELECT a.id AS of, b.id, b.i - a.i AS \"offset\" FROM r a JOIN r b ON a.s = b.s AND b.i BETWEEN a.i - 2 AND a.i + 1 WHERE a.event_type = 'purchase'")
def context_window(spark, d):
    e = bridge.actions(spark, d)
    return sequence.context(e, e.where("tool_name = 'purchase'").select("id"), 2, 1).select("of", "id", F.col("offset").cast("bigint").alias("offset"))


# --------------------------------------------------------------------------- recursion
def _places(spark: SparkSession, d: str) -> DataFrame:
    """region > nation > supplier as edges (a, b)."""
    n, s = bridge.read(spark, d, "nation"), bridge.read(spark, d, "supplier")
    edge = lambda a, x, b, y: (F.concat(F.lit(a), x.cast("string")).alias("a"), F.concat(F.lit(b), y.cast("string")).alias("b"))
    return n.select(*edge("r", F.col("n_regionkey"), "n", F.col("n_nationkey"))).unionByName(s.select(*edge("n", F.col("s_nationkey"), "s", F.col("s_suppkey"))))


PLACES = "edge AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


@query("r_descendants", f"WITH RECURSIVE {PLACES}, down AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT b, depth + 1 FROM down JOIN edge ON a = node) SELECT node, depth FROM down")
def descendants(spark, d):
    return traversal.descendants(_places(spark, d), spark.createDataFrame([("r1",)], "node string"))


@query("r_reaches", f"WITH RECURSIVE {PLACES}, down AS (SELECT b AS node FROM edge WHERE a = 'r2' UNION SELECT b FROM down JOIN edge ON a = node) SELECT node FROM down WHERE node LIKE 's%'")
def reaches(spark, d):
    e = _places(spark, d)
    return traversal.reaches(e, spark.createDataFrame([("r2",)], "node string"), e.where("b LIKE 's%'").select(F.col("b").alias("node")).distinct())


@query("r_family", f"WITH RECURSIVE {PLACES}, up AS (SELECT 'n7' AS node UNION SELECT a FROM up JOIN edge ON b = node), root AS (SELECT node FROM up WHERE node NOT IN (SELECT b FROM edge)), down AS (SELECT node FROM root UNION SELECT b FROM down JOIN edge ON a = node) SELECT node AS id FROM down")
def family(spark, d):
    e = _places(spark, d)
    runs = e.select(F.col("b").alias("id"), F.col("b").alias("session_id"), F.col("a").alias("parent_run_id")).unionByName(e.where("a LIKE 'r%'").select(F.col("a").alias("id")).distinct().withColumn("session_id", F.col("id")).withColumn("parent_run_id", F.lit(None).cast("string")))
    return traversal.family_threads(runs.where("id NOT RLIKE '^n7.'"), runs.select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("native_id")), "n7")


# --------------------------------------------------------------------------- ratings and statistics
RATED = "WITH r AS (SELECT d.lang, d.source, l.* FROM labels l JOIN documents d USING (doc_id))"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return bridge.read(spark, d, "labels").join(bridge.read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("l_count_summary", f"{RATED}, k AS (SELECT DISTINCT lang FROM r), v AS (SELECT unnest(['0', '1', '2']) AS label) SELECT k.lang, v.label, (SELECT count(*) FROM r WHERE r.lang = k.lang AND r.quality::VARCHAR = v.label)::DOUBLE AS total FROM k, v")
def count_summary(spark, d):
    return ratings.count_summary(_rated(spark, d).withColumn("value", F.col("quality").cast("string")), ["lang"], ("0", "1", "2"))


@query("l_numeric_summary", f"{RATED} SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS total, min(quality) AS least, max(quality) AS most, round(avg(quality), 6) AS mean FROM r GROUP BY lang")
def numeric_summary(spark, d):
    parts = ratings.numeric_summary(_rated(spark, d), ["lang", "source"], value="quality")
    return ratings.merge_numeric(parts, ["lang"]).withColumn("mean", F.round("mean", 6))


@query("l_rollup", f"{RATED}, x AS (SELECT doc_id, quality, unnest(['lang:' || lang || '#' || source, 'lang:' || lang]) AS target FROM r) SELECT target, count(DISTINCT doc_id) AS items, sum(quality)::BIGINT AS total FROM x GROUP BY target")
def rollup(spark, d):
    rows = _rated(spark, d).select(F.concat(F.lit("lang:"), "lang", F.lit("#"), "source").alias("target"), F.col("doc_id").alias("item_id"), "quality")
    return ratings.roll_up(rows).groupBy("target").agg(F.count("*").alias("items"), F.sum("quality").alias("total"))


@query("l_since_last_modification", "WITH e AS (SELECT o_custkey, o_orderkey, o_orderstatus, max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS last FROM orders) SELECT o_orderkey AS ord FROM e WHERE o_orderstatus <> 'P' AND (last IS NULL OR o_orderkey > last)")
def since_modification(spark, d):
    o = bridge.read(spark, d, "orders")
    entries = o.select(F.col("o_custkey").alias("lineage"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "P", "modified").otherwise("rated").alias("kind"))
    return ratings.since_last_modification(entries).select("ord")


@query("a_kappa", f"{RATED}, k AS (SELECT lang, count(*) AS n, avg((quality = toxic)::INT) AS agree, avg(quality) AS p, avg(toxic) AS q FROM r GROUP BY lang) SELECT lang, n, round((agree - (p * q + (1 - p) * (1 - q))) / nullif(1 - (p * q + (1 - p) * (1 - q)), 0), 6) AS kappa FROM k")
def kappa(spark, d):
    return ratings.kappa(_rated(spark, d), F.col("quality"), F.col("toxic"), ["lang"]).select("lang", "n", F.round("kappa", 6).alias("kappa"))


@query("a_mode_table", f"{DAY} SELECT outcome AS mode, count(*) AS findings, count(DISTINCT split_part(case_id, ':', 1)) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM q GROUP BY outcome")
def mode_table(spark, d):
    c = day_cases(spark, d)
    total = c.agg(F.count("*").alias("total"))
    out = c.groupBy(F.col("outcome").alias("mode")).agg(F.count("*").alias("findings"), F.countDistinct(F.split_part("case_id", F.lit(":"), F.lit(1))).alias("users"))
    return out.crossJoin(F.broadcast(total)).select("mode", "findings", "users", F.round(F.col("findings") / F.col("total"), 6).alias("share"))


PAIRS = "WITH p AS (SELECT l_partkey AS task, p_brand AS family, CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'B' END AS arm, row_number() OVER (PARTITION BY l_partkey, l_linestatus ORDER BY l_orderkey, l_linenumber) AS rep, l_discount * 10 AS score FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT a.family, a.task, avg(b.score - a.score) AS difference FROM p a JOIN p b ON a.task = b.task AND a.rep = b.rep AND a.arm = 'A' AND b.arm = 'B' GROUP BY ALL)"


def _records(spark: SparkSession, d: str, family: str = "p_brand") -> DataFrame:
    l, p = bridge.read(spark, d, "lineitem"), bridge.read(spark, d, "part")
    rep = F.row_number().over(Window.partitionBy("l_partkey", "l_linestatus").orderBy("l_orderkey", "l_linenumber"))
    return l.withColumn("repetition", rep).join(p, l.l_partkey == p.p_partkey).select(F.col("l_partkey").alias("task"), F.col(family).alias("family"), F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("arm"), "repetition", (F.col("l_discount") * 10).alias("score"))


@query("st_task_differences", f"{PAIRS} SELECT family, task, round(difference, 6) + 0 AS difference FROM d")
def task_differences(spark, d):
    return statistics.task_differences(_records(spark, d)).withColumn("difference", F.round("difference", 6) + 0)


@query("st_family_delta", f"{PAIRS} SELECT family, round(avg(difference), 6) AS difference, count(*) AS tasks FROM d GROUP BY family")
def family_delta(spark, d):
    return statistics.family_differences(_records(spark, d)).withColumn("difference", F.round("difference", 6))


TYPES = PAIRS.replace("p_brand AS family", "p_type AS family")


@query("st_sign_flip_exact", f"{TYPES}, f AS (SELECT family, avg(difference) AS v, row_number() OVER (ORDER BY family) - 1 AS i FROM d GROUP BY family), s AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -v ELSE v END) AS t FROM range(1 << (SELECT count(*) FROM f)::INT) r(m), f GROUP BY m) SELECT round(avg((abs(t) >= (SELECT abs(sum(v)) FROM f) - 1e-12)::INT), 6) AS p FROM s")
def sign_flip(spark, d):
    """Families are the types of parts: few enough for all sign patterns."""
    values = [r.difference for r in statistics.family_differences(_records(spark, d, "p_type")).orderBy("family").collect()]
    return statistics.sign_flip_exact(spark, values).select(F.round("p", 6).alias("p"))


@query("st_sign_flip")
def sign_flip_sampled(spark, d):
    """Families are the brands: too many for all sign patterns, so they are drawn."""
    values = [r.difference for r in statistics.family_differences(_records(spark, d)).orderBy("family").collect()]
    return spark.createDataFrame([(len(values), round(statistics.sign_flip(spark, values), 6))], "families long, p double")


# --------------------------------------------------------------------------- text
@query("f_redaction", r"SELECT doc_id, regexp_replace(text, '((?i:token)\s*=\s*"+'"'+r")[0-9][0-9a-f]{39}', '\1[REDACTED:assignment]', 'g') AS text FROM documents")
def redact(spark, d):
    return bridge.read(spark, d, "documents").select("doc_id", redaction.redacted(F.col("text")).alias("text"))


@query("f_redaction_counts", r"SELECT 'assignment' AS kind, sum(len(regexp_extract_all(text, '(?i:token)\s*=\s*"+'"'+r"[0-9][0-9a-f]{39}')))::BIGINT AS n FROM documents HAVING n > 0")
def redact_counts(spark, d):
    counts = bridge.read(spark, d, "documents").select(F.explode(redaction.redaction_counts(F.col("text"))).alias("kind", "n"))
    return counts.groupBy("kind").agg(F.sum("n").alias("n"))


FOLDERS, ENDINGS = ("src", "tests", "a/spec/b", "docs", "."), (".py", ".md", ".toml", ".json", ".rs", ".xyz", "_test.go", ".spec.ts", "", ".yml", ".TXT", ".sql")


@query("f_file_kind", f"WITH x AS (SELECT p_partkey, {list(FOLDERS)}[p_size % 5 + 1] AS f, {list(ENDINGS)}[p_partkey % 12 + 1] AS e FROM part) SELECT p_partkey, CASE WHEN f IN ('tests', 'a/spec/b') OR e IN ('_test.go', '.spec.ts') THEN 'test' WHEN e IN ('.toml', '.json', '.yml') THEN 'config' WHEN e IN ('.md', '.TXT') THEN 'docs' WHEN e IN ('.py', '.rs', '.sql') THEN 'src' ELSE 'other' END AS kind FROM x")
def file_kind(spark, d):
    """Parts as files: their names below a folder by size, with an ending by key."""
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    path = F.concat(pick(FOLDERS, F.col("p_size")), F.lit("/"), F.regexp_replace("p_name", r"\W+", "_"), pick(ENDINGS, F.col("p_partkey")))
    return bridge.read(spark, d, "part").select("p_partkey", labels.file_kind(path).alias("kind"))


@query("f_command_family", "SELECT event_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'test' WHEN 'error' THEN 'install' WHEN 'signup' THEN 'git' ELSE 'other' END AS family FROM events")
def command_family(spark, d):
    c = F.col("event_type")
    command = F.when(c == "view", "cd app && grep -n x f | head").when(c == "click", "FOO=1 timeout 5 pytest -q; ls").when(c == "error", "(pip install x) || true").when(c == "signup", "git status").otherwise("launch it")
    return bridge.read(spark, d, "events").select("event_id", labels.command_family(command).alias("family"))


@query("f_word_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))::BIGINT AS words FROM documents")
def word_counts(spark, d):
    return bridge.read(spark, d, "documents").select("doc_id", F.size(word_tokens(F.col("text"))).cast("bigint").alias("words"))


@query("f_outline")
def outlines(spark, d):
    text = F.concat(F.lit("# "), F.substring_index("text", "\n", 1), F.lit("\n"), "text", F.lit("\n## End\n"))
    return bridge.read(spark, d, "documents").select("doc_id", F.explode(outline.outline(text)).alias("x")).select("doc_id", "x.*")


# --------------------------------------------------------------------------- graphs
def day_world(spark: SparkSession, d: str):
    from .operators import graphs

    return graphs.from_sequences(day_cases(spark, d))


def graph(name: str, text: str, sql: str | None, *columns: str) -> None:
    """Register a graph query, returning key columns."""
    from .operators import graphs

    query(name, sql)(lambda spark, d: graphs.query(day_world(spark, d), text).select(*columns))


graph("g_path_pattern", 'path:"error -> view ->> purchase" select:walk', f"{DAY}, x AS (SELECT case_id, '<' || array_to_string(names, '><') || '>' AS s FROM q) SELECT case_id AS walk_id FROM x WHERE regexp_matches(s, '<error><view>(<[^>]*>)*?<purchase>')", "walk_id")
graph("g_path_anchored", 'path:"^START -> !error -> cl*" select:walk', f"{DAY} SELECT case_id AS walk_id FROM q WHERE names[2] <> 'error' AND starts_with(names[3], 'cl')", "walk_id")
graph("g_edge_term", 'edge:"error -> *" select:edge', f"{DAY} SELECT DISTINCT source, target FROM t WHERE source = 'error'", "source", "target")
graph("g_numeric_property", "node.visits>1000 select:node", f"{DAY} SELECT name AS node_id FROM (SELECT unnest(names) AS name FROM q) GROUP BY name HAVING count(*) > 1000", "node_id")
graph("g_boolean_walks", 'label:sign -label:rro outcome:completed select:walk', f"{DAY} SELECT case_id AS walk_id FROM q WHERE len(list_filter(names, lambda x: contains(lower(x), 'sign'))) > 0 AND len(list_filter(names, lambda x: contains(lower(x), 'rro'))) = 0 AND outcome = 'completed'", "walk_id")
graph("g_walk_length", "steps>=9 select:walk", f"{DAY} SELECT case_id AS walk_id FROM q WHERE len(names) >= 9", "walk_id")
graph("g_session_prefix", "session:12 label:/^(view|END:.*)$/ select:walk", f"{DAY} SELECT case_id AS walk_id FROM q WHERE starts_with(case_id, '12')", "walk_id")
graph("g_failed_outcome", "outcome:failed case:1 select:walk", f"{DAY} SELECT case_id AS walk_id FROM q WHERE outcome IN ('failed', 'abandoned', 'user_aborted', 'error', 'branch_abandoned') AND starts_with(case_id, '1')", "walk_id")
graph("g_path_open_ends", 'path:"^ ->> signup ->> $" -path:"^START -> view ->> $" select:walk', f"{DAY} SELECT case_id AS walk_id FROM q WHERE list_contains(names, 'signup') AND names[2] <> 'view'", "walk_id")
graph("g_node_by_walk", "outcome:completed select:node", f"{DAY} SELECT DISTINCT unnest(names) AS node_id FROM q WHERE outcome = 'completed'", "node_id")
graph("g_loop_iterations", 'loop:"view click" iterations>=2 select:walk', f"{DAY}, x AS (SELECT case_id, '<' || array_to_string(names, '><') || '>' AS s FROM q) SELECT case_id AS walk_id FROM x WHERE contains(s, '<view><click><view><click>') OR contains(s, '<click><view><click><view>')", "walk_id")
STEPS = "e AS (SELECT (user_id % 50)::VARCHAR AS g, 'v' || floor(value / 10)::BIGINT::VARCHAR AS a, lead('v' || floor(value / 10)::BIGINT::VARCHAR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), arc AS (SELECT DISTINCT g, a, b FROM e WHERE a < b)"


def user_worlds(spark: SparkSession, d: str):
    """A graph for each of 50 groups of users, of how values rise from event to event: nodes are the values' tens."""
    from .operators import graphs

    e = bridge.read(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("graph_id"), "user_id", "ts", "event_id", F.concat(F.lit("v"), F.floor(F.col("value") / 10).cast("string")).alias("node_id"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    arcs = e.select("graph_id", F.col("node_id").alias("source"), F.lead("node_id").over(w).alias("target")).where("target IS NOT NULL AND source < target").distinct()
    empty = lambda t: spark.createDataFrame([], graphs.TABLES[t])
    return graphs.World(graphs._shaped(e.select("graph_id", F.lit("aeg").alias("kind")).distinct(), "graphs"), graphs._shaped(e.select("graph_id", "node_id", F.col("node_id").alias("label")).distinct(), "nodes"), graphs._shaped(arcs.withColumn("relation", F.lit("next")), "edges"), empty("walks"), empty("occurrences"), empty("annotations"))


@query("g_reaches", f"WITH RECURSIVE {STEPS}, reach AS (SELECT g, b AS x FROM arc WHERE a = 'v2' UNION SELECT reach.g, arc.b FROM reach JOIN arc ON arc.g = reach.g AND arc.a = reach.x) SELECT DISTINCT g AS graph_id FROM reach WHERE starts_with(x, 'v2')")
def reaches(spark, d):
    from .operators import graphs

    return graphs.query(user_worlds(spark, d), 'reaches:"v2 ~> v2*" select:graph').select("graph_id")


@query("g_cross_kind_events", f"{LOG} SELECT id AS event_id FROM e WHERE event_type = 'purchase'")
def cross_kind(spark, d):
    """Events of the work graph's nodes, by the events that visits share."""
    from .operators import graphs

    return graphs.query(graphs.from_events(bridge.actions(spark, d).withColumn("kind", F.col("tool_name"))), "label:purchase select:event").select("event_id")


@query("g_work_edges", f"{LOG} SELECT id AS source, lead(id) OVER (PARTITION BY s ORDER BY ts, id) AS target FROM e QUALIFY target IS NOT NULL")
def work_edges(spark, d):
    from .operators import graphs

    return graphs.from_events(bridge.actions(spark, d)).edges.where("relation = 'next'").select("source", "target")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """The log with every even step as a call and every odd one as its result."""
    e = sequence.positions(bridge.actions(spark, d))
    return e.withColumn("kind", F.when(F.col("i") % 2 == 0, "tool_call").otherwise("tool_result")).withColumn("call_id", F.floor(F.col("i") / 2).cast("string")).drop("i")


PAIRED = f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, id) - 1 AS i FROM e)"


@query("k_decision_episodes", f"{PAIRED} SELECT c.id, 'action' AS kind, CASE WHEN x.id IS NULL THEN 1 ELSE 2 END AS events, x.status FROM r c LEFT JOIN r x ON x.s = c.s AND x.i = c.i + 1 WHERE c.i % 2 = 0")
def decision_episodes(spark, d):
    return episodes.decision_trace(_paired(spark, d))[0].select("id", "kind", F.size("event_ids").alias("events"), "status")


@query("k_decision_edges", f"{PAIRED} SELECT id AS source, lead(id) OVER (PARTITION BY s ORDER BY i) AS target, 'then' AS relation FROM r WHERE i % 2 = 0 QUALIFY target IS NOT NULL")
def decision_edges(spark, d):
    return episodes.decision_trace(_paired(spark, d))[1].where("relation = 'then'")


@query("k_overview", f"{CHAT}, t AS (SELECT s, turn, role, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x FROM m WHERE trim(text) <> '') SELECT m.s AS session_id, first(x ORDER BY t.turn) FILTER (t.role = 'user') AS first_prompt, first(x ORDER BY t.turn) FILTER (t.role = 'assistant') AS first_reply, last(x ORDER BY t.turn) FILTER (t.role = 'assistant') AS last_reply FROM (SELECT DISTINCT s FROM m) m LEFT JOIN t ON t.s = m.s GROUP BY m.s")
def overviews(spark, d):
    return episodes.overview(bridge.messages(spark, d), chars=1 << 20)


# --------------------------------------------------------------------------- filters and values
@query("p_filter_lists", f"{CHAT} SELECT id FROM m WHERE role IN ('user', 'system') AND contains(low, 'the') AND turn::VARCHAR <> ''")
def filter_lists(spark, d):
    return filters.search(bridge.chat_store(spark, d), "THE", roles=["user", "system"], kind="message").select("id")


@query("p_filter_dates", f"{LOG} SELECT id FROM e JOIN p USING (s) WHERE started > TIMESTAMP '2024-01-01 03:00:00' AND started < TIMESTAMP '2024-01-01 18:00:00' AND status = 'failure' AND event_type = 'error'")
def filter_dates(spark, d):
    utc = lambda h: datetime(2024, 1, 1, h, tzinfo=UTC)
    return filters.search(bridge.log_store(spark, d), after=utc(3), before=utc(18), status="failure", tool_names=["error"]).select("id")


@query("p_filter_without_call", f"{CALLS} SELECT DISTINCT s AS id FROM n WHERE s NOT IN (SELECT s FROM n WHERE kind = 'tool_call' AND contains(props, '77'))")
def filter_without_call(spark, d):
    store = Store.of(_as_calls(spark, d))
    return filters.Filters.of(without_call="77").sessions(store).select("id")


@query("p_listing", f"{LOG}, x AS (SELECT s AS id, max(ts) AS ended FROM e GROUP BY s) SELECT id FROM x ORDER BY ended, id LIMIT 20 OFFSET 5")
def listing(spark, d):
    return filters.listing(bridge.log_store(spark, d).sessions, limit=20, offset=5).select("id")


@query("f_token_estimate", "SELECT doc_id, (length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def token_estimates(spark, d):
    return bridge.read(spark, d, "documents").select("doc_id", values.token_estimate(F.col("text")).alias("tokens"))


RELEASES = [("2024-01-01 05:00:00", "r1"), ("2024-01-01 12:30:00", "r2"), ("2024-01-02 00:00:00", "r3")]


@query("d_release_in_force", f"WITH r AS (SELECT unnest({[t for t, _ in RELEASES]})::TIMESTAMP AS since, unnest({[n for _, n in RELEASES]}) AS release) SELECT event_id, release FROM events ASOF LEFT JOIN r ON ts >= since")
def release_in_force(spark, d):
    releases = spark.createDataFrame(RELEASES, "since string, release string").withColumn("since", F.to_timestamp("since"))
    e = bridge.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("started_at"))
    return values.in_force(e, releases).select("event_id", "release")


# --------------------------------------------------------------------------- transcripts
def _exported(harness: str):
    """Conversations and the paired log, written as a harness's transcripts and read again."""

    def run(spark, d):
        from .sources import transcript_export, transcripts

        folder = f"{shared_folder(spark)}/loomtrace-{harness}-{uuid4().hex}"
        events = bridge.messages(spark, d).unionByName(_paired(spark, d).drop("ts"))
        transcript_export.write(transcript_export.export(events, harness, strict=False), folder)
        rows = transcripts.events_of(transcripts.read(spark, harness, folder, glob="part-*")).where("kind <> 'metadata'")
        w = Window.partitionBy("session_id").orderBy("byte_offset", "subrecord")
        return rows.select("session_id", F.row_number().over(w).alias("n"), "kind", "role", F.when(F.col("kind") == "tool_call", F.col("tool_name")).otherwise(F.col("text")).alias("said"), "status")

    return run


def _as_written(system: str, outcome: str) -> str:
    """What comes back: messages, calls and results of each session in order."""
    return f"""{PAIRED}, m AS (SELECT conv_id::VARCHAR AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations),
every AS (SELECT s, 0 AS part, n, 'message' AS kind, CASE WHEN role = 'system' THEN {system} ELSE role END AS role, text AS said, NULL AS status, role = 'system' AS sys FROM m
UNION ALL SELECT s, 1, i + 1, CASE WHEN i % 2 = 0 THEN 'tool_call' ELSE 'tool_result' END, CASE WHEN i % 2 = 0 THEN 'assistant' ELSE 'tool' END, CASE WHEN i % 2 = 0 THEN event_type ELSE props END, CASE WHEN i % 2 = 1 THEN {outcome} END, false FROM r)
SELECT s AS session_id, row_number() OVER (PARTITION BY s ORDER BY part, n) AS n, kind, role, CASE WHEN sys AND role = 'user' THEN '[system message]' || chr(10) || said ELSE said END AS said, status FROM every"""


FAIL_ONLY, BOTH = "CASE WHEN status = 'failure' THEN 'failure' END", "status"
for _h, _system, _status in (("claude", "'user'", FAIL_ONLY), ("codex", "'system'", BOTH), ("pi", "'system'", FAIL_ONLY), ("opencode", "'system'", BOTH), ("antigravity", "'system'", BOTH)):
    query(f"x_transcripts_{_h}", _as_written(_system, _status))(_exported(_h))


# --------------------------------------------------------------------------- cases
def _log_cases(spark: SparkSession, d: str):
    """The log as agent work: signups prompt, purchases answer, clicks edit, views run tests, errors are their results."""
    from .operators import cases

    e, kind = bridge.actions(spark, d), F.col("tool_name")
    w = sequence.stream()
    call = kind.isin("view", "click")
    e = e.withColumn("kind", F.when(call, "tool_call").when(kind == "error", "tool_result").otherwise("message")).withColumn("role", F.when(kind == "signup", "user").when(kind == "purchase", "assistant").otherwise("tool"))
    e = e.withColumn("call_id", F.when(call, F.col("id")).when(kind == "error", F.lag("id").over(w)))
    e = e.withColumn("arguments", F.when(kind == "view", '{"command": "pytest -q"}').when(kind == "click", '{"file_path": "src/a.py"}')).withColumn("action_kind", F.when(kind == "view", "shell.exec").when(kind == "click", "file.patch")).withColumn("tool_name", F.when(kind == "view", "bash").when(kind == "click", "edit"))
    e = e.withColumn("text", F.when(kind == "signup", F.concat(F.lit("please add "), "id")).when(kind == "purchase", F.concat(F.lit("all tests pass "), "id")).otherwise("")).withColumn("native_id", F.lit(None).cast("string")).withColumn("status", F.when(F.col("kind") == "tool_result", "failure"))
    return cut(cases.actions(cases.case_rows(e)))


@query("c_actions", f"{LOG}, n AS (SELECT *, lead(event_type) OVER (PARTITION BY s ORDER BY ts, id) AS nxt FROM e) SELECT CASE event_type WHEN 'view' THEN CASE nxt WHEN 'error' THEN 'TEST:fail' ELSE 'TEST' END WHEN 'click' THEN CASE nxt WHEN 'error' THEN 'EDIT:src:fail' ELSE 'EDIT:src' END END AS label, count(*) AS n FROM n WHERE event_type IN ('view', 'click') GROUP BY 1")
def actions(spark, d):
    return _log_cases(spark, d).where("family IN ('TEST', 'EDIT')").groupBy("label").agg(F.count("*").alias("n"))


@query("c_outcomes")
def outcomes(spark, d):
    from .operators import cases

    return cases.outcomes(_log_cases(spark, d))


@query("c_states")
def case_states(spark, d):
    from .operators import cases

    return cases.states(_log_cases(spark, d)).select("case_id", "pos", "name", "repeat")


@query("c_findings")
def findings(spark, d):
    from .operators import cases

    steps = _log_cases(spark, d)
    return cases.findings(steps, cases.outcomes(steps)).groupBy("mode").agg(F.count("*").alias("n"))


@query("c_critical_steps")
def critical(spark, d):
    from .operators import cases

    steps = _log_cases(spark, d)
    results = cases.outcomes(steps)
    return cases.critical_steps(steps, results, cases.findings(steps, results)).groupBy("category").agg(F.count("*").alias("n"))


@query("c_archetypes")
def archetypes(spark, d):
    from .operators.archetypes import archetypes

    return archetypes(day_cases(spark, d)).groupBy("cluster").agg(F.count("*").alias("cases"))
