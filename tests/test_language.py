"""The search language: grammar, and plans on a small store."""

import pytest

from loomtrace.model import EVENT, Store
from loomtrace.plans.compiler import match_ranges, run
from loomtrace.plans.language import And, Not, Or, QueryError, Term, parse


def test_precedence_and_adjacency():
    q = parse("a b or not c").node
    assert isinstance(q, Or) and isinstance(q.items[0], And) and isinstance(q.items[1], Not)
    assert [t.value for t in q.items[0].items] == ["a", "b"]


@pytest.mark.parametrize(("text", "field", "operator", "value", "regex"), [
    ("hello", "content", "contains", "hello", False), ('"and"', "content", "contains", "and", False), ("/a b/", "content", "contains", "a b", True),
    ("role:User", "role", "is", "User", False), ("type:message", "kind", "is", "message", False), ("shell.startswith:git", "shell", "startswith", "git", False),
    ("user.matches:^x", "user", "matches", "^x", True), ("http://x.org", "content", "contains", "http://x.org", False), (r'user:"a \"b\""', "user", "contains", 'a "b"', False),
    ("cwd:/a/b/", "cwd", "is", "/a/b/", False), ("-word", "content", "contains", "-word", False)])
def test_terms(text, field, operator, value, regex):
    t = parse(text).node
    assert isinstance(t, Term) and (t.field, t.operator, t.value, t.regex) == (field, operator, value, regex)


def test_parentheses_that_do_not_pair_are_text():
    assert [t.value for t in parse("def fun(").node.items] == ["def", "fun("]
    assert parse("foo)").node.value == "foo)"
    assert parse("call:f(x)").node.value == "f(x)"


@pytest.mark.parametrize("text", ["or", "a and", "role:", "select:x", "count:0", "(select:event)", "case:yes case:no", "patterntype:lexical case:yes a", "/(/", 'x "open', "role.like:a"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


ROWS = [
    # session, run, parent, offset, kind, role, tool, action, call, status, text, time
    ("s1", "r1", None, 0, "message", "user", None, None, None, None, "Fix the Straße parser", "2024-01-01T00:00:00Z"),
    ("s1", "r1", None, 1, "tool_call", "assistant", "bash", "shell.exec", "c1", None, '{"command": "pytest -q"}', "2024-01-01T00:01:00Z"),
    ("s1", "r1", None, 2, "tool_result", "tool", None, None, "c1", "failure", "1 failed", "2024-01-01T00:02:00Z"),
    ("s1", "r2", "r1", 0, "message", "assistant", None, None, None, None, "child says hello", "2024-01-01T00:03:00Z"),
    ("s2", "r3", None, 0, "message", "user", None, None, None, None, "hello there", "2024-02-01T00:00:00Z"),
    ("s2", "r3", None, 1, "message", "system", None, None, None, None, "hello system", "2024-02-01T00:00:01"),
]


@pytest.fixture(scope="module")
def store(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    names = ("session_id", "run_id", "parent_run_id", "byte_offset", "kind", "role", "tool_name", "action_kind", "call_id", "status", "text", "ts_text")
    rows = spark.createDataFrame(ROWS, "session_id string, run_id string, parent_run_id string, byte_offset long, kind string, role string, tool_name string, action_kind string, call_id string, status string, text string, ts_text string")
    fixed = {"id": F.concat_ws("-", "run_id", "byte_offset"), "source_id": F.lit("src"), "harness": F.lit("claude"), "path": F.col("run_id"), "generation": F.lit(0), "subrecord": F.lit(0), "cwd": F.when(F.col("session_id") == "s1", "/w/app"), "arguments": F.when(F.col("kind") == "tool_call", F.col("text"))}
    events = rows.select(*((fixed[f.name] if f.name in fixed else F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENT)))
    reflections = spark.createDataFrame([("x1", "s1", "2024-03-01", "ask1", "1.4.0@rev", "reflect", "2")], "id string, session_id string, at string, asked string, revision string, prompt_name string, prompt_version string")
    ratings = spark.createDataFrame([("x1", "outcome", "helpful", "skill:pdf#Use", "r"), ("x1", "failure_mode", "no_verification", "context:A.md", "q")], "reflection_id string, scale string, rating string, target string, ref string")
    tags = spark.createDataFrame([("r2-0", "reflection:x1")], "event_id string, tag string")
    coverage = spark.createDataFrame([("s1", "ask1", "1.4.0@rev", "partial")], "session_id string, asked string, revision string, state string")
    return Store.of(events, reflections=reflections, ratings=ratings, tags=tags, coverage=coverage)


@pytest.mark.parametrize(("text", "want"), [
    ("hello", ["r3-0"]), ("hello internal:yes", ["r2-0", "r3-0", "r3-1"]), ("strasse", ["r1-0"]), ("STRASSE case:yes", []), ("user.startswith:fix", ["r1-0"]), ("user:/fix .* str.{1,2}e/", ["r1-0"]),
    ("status:failure kind:tool_call", ["r1-1"]), ("tool:bash kind:tool_result", ["r1-2"]), ("action:shell", ["r1-1", "r1-2"]), ("shell.startswith:pytest status:failure", ["r1-1"]),
    ("select:thread at:child", ["r2"]), ("select:thread user:fix", ["r1"]), ("select:thread -user:fix", ["r2", "r3"]), ("select:session user:hello -call:pytest", ["s2"]), ("select:session shell:pytest", ["s1"]),
    ("select:session after:2024-01-15", ["s2"]), ("select:session before:2024-01-15", ["s1"]), ("select:session cwd:/w", ["s1"]), ("select:session -cwd:/w", []), ("select:thread family:r2", ["r1", "r2"]),
    ("select:session reflected:yes", ["s1"]), ("select:session -reflected:yes", ["s2"]), ("select:session prompt:reflect@2 rated:helpful", ["s1"]), ("select:session rated:no_verification", []), ("select:session failure:no_verification", ["s1"]),
    ("select:session target:skill:pdf", ["s1"]), ("select:session coverage:partial", ["s1"]), ("select:session coverage:none asked:ask1", ["s2"]), ("select:session coverage:full", []), ("select:reflection revision:1.4.0", ["x1"]), ("select:session (user:fix or user:hello) count:1", ["s2"]),
    ("tag:reflection", ["r2-0"]), ("hello patterntype:lexical", ["r3-0"]), ("select:session thread:r2", ["s1"])])
def test_results(store, text, want):
    assert sorted(r.id for r in run(store, text).collect()) == sorted(want)


def test_order_limit_and_scope(store, spark):
    assert [r.id for r in run(store, "select:session").collect()] == ["s2", "s1"]
    assert [r.id for r in run(store, "select:session", limit=1, offset=1).collect()] == ["s1"]
    assert [r.id for r in run(store, "hello or fix", within=spark.createDataFrame([("r1-0",)], "id string")).collect()] == ["r1-0"]


def test_ranges_count_code_points(spark):
    rows = spark.createDataFrame([("eine Straße und STRASSE",), (None,)], "text string")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(match_ranges("strasse or -x", F.col("text"))).collect()]
    assert [(s.start, s.end) for s in got[0]] == [(5, 11), (16, 23)] and got[1] is None
