"""Reflections, coverage, the journal and exports on small records."""

import json

from pyspark.sql import functions as F

from loomtrace.operators import journal, reflections
from loomtrace.sources import exports
from tests.test_operators import USER, SAYS, call, events, result


def test_reflections_bind_tag_and_cover(spark):
    rows = [USER, SAYS, call(ident="m", arguments="{}"), result("success", "m", "mark_ABCDEF12"), USER, SAYS, SAYS]
    e = events(spark, rows)
    record = {"id": "x", "session": None, "thread": None, "at": "2024", "revision": "1@r", "mode": "in-session", "trigger": "t", "marker": "mark_ABCDEF12", "prompt": {"name": "reflect", "version": "1", "hash": "p_1"}, "schema": "s_1", "asked": "q", "reflector": {"harness": "h", "model": "m"}, "items": [{"path": "/a", "ref": "skill_file:pdf/x.md#L1", "scale": "outcome", "rating": "helpful"}]}
    records = spark.createDataFrame([json.dumps(record)] * 2, "string").select(F.from_json("value", reflections.SCHEMA).alias("r")).select("r.*")
    refl, ratings = reflections.flatten(records)
    assert refl.count() == 1 and ratings.first().target == "skill:pdf" and reflections.conflicting(records).count() == 0
    sessions = spark.createDataFrame([("S", None)], "id string, native_id string")
    bound = reflections.bind(refl, sessions, e)
    assert bound.first().session_id == "S"
    tags = reflections.turns(bound, e)
    assert {r.event_id for r in tags.collect()} == {"e002", "e003"}
    cover = reflections.coverage(bound, e, tags).first()
    assert (cover.covered_to, cover.tail, cover.state) == (2, 3, "partial")
    assert reflections.partition(sessions, reflections.coverage(bound, e, tags), "q").first().state == "partial"
    assert reflections.partition(sessions, reflections.coverage(bound, e, tags), "other").first().state == "unreflected"
    assert reflections.remembered(bound).count() == 1


def test_changes_and_net_differences(spark):
    before = spark.createDataFrame([("s:a", "one"), ("s:b", "two"), ("s:c", "same"), ("s:d", "x")], "target string, content string")
    after = spark.createDataFrame([("s:a", "one!"), ("s:m", "two"), ("s:c", "same"), ("s:n", "new")], "target string, content string")
    assert {(r.kind, r.target, r.previous) for r in journal.detect_changes(before, after).collect()} == {("modified", "s:a", None), ("moved", "s:m", "s:b"), ("removed", "s:d", None), ("added", "s:n", None)}
    entries = spark.createDataFrame([("1", "added", "L1", None, "a"), ("2", "modified", "L1", "a", "b"), ("3", "added", "L2", None, "z"), ("4", "removed", "L2", "z", None)], "id string, kind string, lineage string, before string, after string")
    row = journal.net_diff(entries).collect()
    assert [(r.lineage, r.before, r.after) for r in row] == [("L1", None, "b")] and "+b" in row[0].diff


def test_journal_files(spark, tmp_path):
    line = json.dumps({"id": "1", "kind": "rated", "target": "skill:a#B"})
    (tmp_path / "j.jsonl").write_text(f'{line}\n{line}\n{{"id": "2", "kind": "ra')
    entries = journal.read(spark, str(tmp_path / "j.jsonl"))
    assert [r.id for r in entries.collect()] == ["1"] and journal.conflicts(entries).count() == 0
    hit = lambda t, p: spark.range(1).select(journal.matches(F.lit(t), p)).first()[0]
    assert hit("skill:a#B > C", "skill:a#B") and hit("skill_file:a/x.md", "skill:a") and hit("skill:abc", "skill:a*") and not hit("skill:ab", "skill:a")


def test_drift_and_agreement(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "target string, content string")
    copies = spark.createDataFrame([("h1", "a", "1x"), ("h2", "a", "1"), ("h1", "b", "2y"), ("h2", "b", "2z")], "holder string, target string, content string")
    assert {(r.target, r.kind) for r in journal.installation_drift(base, copies).collect()} == {("a", "modified"), ("b", "conflict"), ("c", "removed")}
    f = lambda rows: spark.createDataFrame(rows, "case_id string, mode string")
    row = journal.agreement(f([("1", "m"), ("2", "m")]), f([("2", "m"), ("3", "m")])).first()
    assert (row.both, row.rules_only, row.judge_only) == (1, 1, 1)


def test_exports(spark, tmp_path):
    text = exports.markdown(events(spark, [USER, SAYS])).first().markdown
    assert text == "## user\n\ndo it\n\n## assistant\n\ndone"
    edges = spark.createDataFrame([("A", "B", 3)], "source string, target string, count long")
    assert exports.mermaid(edges) == 'graph LR\n  n0["A"]\n  n1["B"]\n  n0 -->|3| n1'
    gold = spark.createDataFrame([("c", "3", "3", "x", "x"), ("d", "3", "5", "x", "y")], "case_id string, idx string, gold_step string, category string, gold_category string")
    assert tuple(exports.evaluate_gold(gold).first()) == (2, 0.5, 0.5, 1.0, 0.5)
    exports.tables(str(tmp_path), edges=edges)
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 1
