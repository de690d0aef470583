"""Exports and their round trips, skills, registered sources, filters, episodes and values, on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import values
from loomtrace.model import EVENT, Store
from loomtrace.operators import episodes, skills
from loomtrace.plans.filters import Filters, search
from loomtrace.sources import registry, transcript_export, transcripts
from tests.test_operators import events

HISTORY = [("message", "user", None, None, "go\nnow", None, None), ("tool_call", "assistant", "Bash", None, '{"command": "ls"}', '{"command": "ls"}', "c1"), ("tool_result", "tool", "Bash", "failure", "gone", None, "c1"), ("message", "assistant", None, None, "done", None, None)]


@pytest.mark.parametrize("target", ["claude", "codex", "pi", "opencode", "antigravity"])
def test_exports_come_back(spark, tmp_path, target):
    e = events(spark, HISTORY)
    lines = transcript_export.export(e, target).orderBy("n").collect()
    name = {"codex": "rollout-1.jsonl", "antigravity": "transcript.jsonl"}.get(target, "s.jsonl")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / name).write_text("".join(x.value + "\n" for x in lines))
    rows = transcripts.read(spark, target, str(tmp_path / "x"))
    assert transcripts.diagnostics(rows).count() == 0
    got = [r for r in transcripts.events_of(rows).orderBy("byte_offset", "subrecord").collect() if r.kind != "metadata"]
    assert [r.kind for r in got] == [h[0] for h in HISTORY]
    assert got[0].text == "go\nnow" and got[3].text == "done" and got[2].text == "gone" and got[2].status == "failure"
    assert json.loads(got[1].arguments) == {"command": "ls"} and got[1].tool_name == "Bash" and got[1].call_id == got[2].call_id


def test_what_a_format_cannot_say(spark):
    odd = [*HISTORY, ("tool_call", "assistant", "Bash", None, "x", "{}", "c1"), ("tool_result", "tool", "Bash", None, "late", None, "c9"), ("thinking", "assistant", None, None, "hm", None, None), ("message", "system", None, None, "rules", None, None), ("metadata", None, None, None, "m", None, None)]
    e = events(spark, odd)
    with pytest.raises(transcript_export.UnsupportedConversion):
        transcript_export.export(e, "claude")
    got = transcript_export.export(e, "claude", strict=False).orderBy("n").collect()
    assert [x.note for x in got] == [None] * 4 + ["a call id that is used again", "a result without its call", "thinking", "system message"]
    assert "late" in got[5].value and transcript_export.export(e, "pi", strict=False).where("note = 'thinking'").count() == 0
    assert transcript_export.export(e).count() == len(odd)
    with pytest.raises(transcript_export.UnsupportedConversion):
        transcript_export.export(e, "word")
    assert transcript_export.export(e.limit(0), "codex").count() == 0


def test_skill_usage(spark):
    call = lambda tool, **a: ("tool_call", "assistant", tool, None, "", json.dumps(a), None)
    rows = [("message", "user", None, None, "/review now", None, None), call("Skill", skill="review"), call("Read", file_path="/p/.claude/skills/review/SKILL.md"), call("Bash", command="cd .codex/skills/review && cat notes.md"), call("Bash", command="bash .agents/skills/review/run.sh -x"),
            call("Bash", command="cat $(ls .claude/skills/review/SKILL.md)"), call("Bash", command="echo x > .claude/skills/review/SKILL.md"), call("Bash", command="head -n 3 .claude/skills/other/SKILL.md"), call("Read", file_path="/p/src/a.py"), ("message", "user", None, None, "please /review", None, None)]
    e = events(spark, rows, action_kind=F.when(F.col("tool_name") == "Bash", "shell.exec").when(F.col("tool_name") == "Read", "file.read"))
    found = lambda **o: [(r.start, r.detail) for r in skills.SkillUsage(**o).matches(e).orderBy("start", "detail").collect()]
    assert found(path="skills/review") == [(0, "requested:review:SKILL.md"), (1, "invoked:review:SKILL.md"), (2, "read:review:SKILL.md"), (3, "read:review:notes.md"), (4, "executed:review:run.sh")]
    assert found(path="skills/review/run.sh") == [(4, "executed:review:run.sh")]
    assert found(files={"other": set()}) == [(7, "read:other:SKILL.md")]
    assert found(path="/p/.claude/skills/review") == [(2, "read:review:SKILL.md")]
    for bad in ({}, {"path": " "}, {"path": "skills/"}):
        with pytest.raises(ValueError):
            skills.SkillUsage(**bad)


@pytest.mark.parametrize(("path", "cwd", "want"), [("a/../b/./c", None, "b/c"), ("../x", "/p/q", "/p/x"), ("/a//b\\c", "/z", "/a/b/c"), ("../../x", None, "../../x")])
def test_paths_resolve(spark, path, cwd, want):
    assert spark.range(1).select(skills.resolved(F.lit(path), F.lit(cwd).cast("string"))).first()[0] == want


def test_registry_sessions_and_snapshots(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path / "sources"))
    assert r.sources().count() == 0
    r.register("a", "claude", "/x", deep=True)
    r.register("a", "claude", "/x", deep=True)
    with pytest.raises(ValueError):
        r.register("a", "claude", "/y")
    assert r.sources().count() == 1
    e = events(spark, HISTORY)
    registry.save_session(e, str(tmp_path / "s"))
    assert registry.open_session(spark, str(tmp_path / "s")).count() == 4
    with pytest.raises(ValueError):
        registry.open_session(spark, str(tmp_path / "s"), version=2)
    spark.read.parquet(str(tmp_path / "s")).where("kind <> 'message'").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        registry.open_session(spark, str(tmp_path / "t"))
    first = registry.snapshot(spark.range(3), str(tmp_path / "snap"), "r1")
    assert first.count() == registry.snapshot(spark.range(9), str(tmp_path / "snap"), "r1").count() == 3
    (tmp_path / "c/runs/b1").mkdir(parents=True)
    (tmp_path / "c/runs/b1/manifest.json").write_text('{"sessions": 2}')
    assert [(x.batch, x.sessions) for x in registry.batches(spark, str(tmp_path / "c")).collect()] == [("b1", 2)]


def test_filters(spark):
    store = Store.of(events(spark, HISTORY))
    ids = lambda **o: sorted(r.id for r in search(store, **o).collect())
    assert ids(kind="message") == ["e000", "e003"] and ids(tool_names=["Bash"]) == ["e001", "e002"] and ids(status="failure") == ["e002"]
    assert ids(text="DONE") == ["e003"] and ids(text="DONE", sensitive=True) == []
    found = search(store, kind="message")
    assert [r.id for r in search(store, text="go", ids=found).collect()] == ["e000"]
    assert Filters.of(without_call="ls").sessions(store).count() == 0 and Filters.of(without_call="zz").sessions(store).count() == 1
    with pytest.raises(TypeError):
        Filters.of(colour="red")


def test_episodes_and_overview(spark):
    e = events(spark, HISTORY)
    nodes, edges = episodes.decision_trace(e)
    got = nodes.orderBy("i").collect()
    assert [(x.kind, x.status, len(x.event_ids)) for x in got] == [("request", None, 1), ("action", "failure", 2), ("response", None, 1)] and "→ gone" in got[1].summary
    assert sorted((x.source, x.target) for x in edges.collect()) == [("e000", "e001"), ("e001", "e003")]
    assert tuple(episodes.overview(e).first())[1:] == ("go now", "done", "done")
    assert [x["text"] for x in episodes.expand(e, ["e003", "e000"], most_chars=4)] == ["do", "go"]
    with pytest.raises(KeyError):
        episodes.expand(e, ["nope"])


def test_values(spark):
    row = spark.range(1).select(values.seconds_between(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-01T00:01:00+00:00")), values.seconds_between(F.lit("2024-01-01T00:01:00Z"), F.lit("2024-01-01T00:00:00Z")), values.seconds_between(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-01T00:01:00")), values.mentioned(F.lit("see skills/a and b-c"), "b"), values.mentioned(F.lit("use b now"), "b"), values.pointer(F.lit('{"a": [{"b/c": 5}]}'), "/a/0/b~1c"), values.has_media(F.lit('{"x": [{"type": "image"}]}')), values.token_estimate(F.lit("123456789"))).first()
    assert tuple(row) == (60.0, 0.0, None, False, True, "5", True, 2)
    ids = spark.sql("SELECT timestamp'2024-01-01' AS a, timestamp'2024-01-02' AS b").select(values.entry_id(F.col("a"), F.lit("x")), values.entry_id(F.col("b"), F.lit("a"))).first()
    assert ids[0] < ids[1] and values.fingerprint("p", {"a": 1, "b": 2}) == values.fingerprint("p", {"b": 2, "a": 1})


@pytest.mark.parametrize("target", ["codex", "pi"])
def test_a_session_is_one_file_that_begins_with_its_opening(spark, tmp_path, target):
    rows = [dict(id=f"{s}-{n}", source_id="a", harness="h", session_id=f"s{s}", run_id=f"s{s}", path=f"s{s}", generation=0, byte_offset=n, subrecord=0, kind="message", role="user", text=hashlib.sha512(f"{s} {n}".encode()).hexdigest()) for s in range(40) for n in range(30)]
    e = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in EVENT.split(", ")) for r in rows], EVENT)
    small = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = [(k, spark.conf.get(k, None)) for k in small]
    try:
        for k, v in zip(small, ("16", "4k", "1k", "false"), strict=True):
            spark.conf.set(k, v)
        transcript_export.write(transcript_export.export(e, target), str(tmp_path / "out"))
    finally:
        for k, v in before:
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for s in range(40):
        files = list((tmp_path / "out" / f"session_id=s{s}").glob("part-*"))
        assert len(files) == 1
        lines = files[0].read_text().splitlines()
        assert len(lines) == 31 and json.loads(lines[0])["type"] in ("session_meta", "session")
