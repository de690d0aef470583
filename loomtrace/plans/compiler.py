"""Search queries to DataFrame plans.

Events match by columns alone.  For threads and sessions every event-level term becomes a boolean column, all of them
are folded in one aggregation (``bool_or`` per unit), and the tree of and, or and not is evaluated on the flags: one
shuffle however many terms there are.  Nulls follow the operators: predicates on text are two-valued; comparisons of
dates, prefixes and folders stay null, so that their negation drops rows without a value.
"""

import os
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shell import commands
from ..model import Store
from ..operators.traversal import family_threads, parent_links, tops
from .language import FIELDS, YES, And, Not, Or, Query, QueryError, Term, parse, positive, required, terms

GUARDS = {
    "content": "kind IN ('message', 'tool_call', 'tool_result') AND coalesce(role, '') NOT IN ('system', 'developer')",
    "message": "kind = 'message'",
    "user": "kind = 'message' AND role = 'user'",
    "assistant": "kind = 'message' AND role = 'assistant'",
    "thinking": "kind = 'thinking'",
    "call": "kind = 'tool_call'",
    "result": "kind = 'tool_result'",
    "shell": "kind = 'tool_call'",
    "file": "kind = 'tool_call' AND action_kind LIKE 'file.%'",
    "rated": "scale NOT LIKE 'failure%'",
    "failure": "scale LIKE 'failure%'",
}
UNIT_KEY = {"thread": "run_id", "session": "session_id", "reflection": "session_id"}
RELATIVE = re.compile(r"(\d+)([hdwHDW])")


def moment(value: str, now: datetime) -> datetime:
    """An ISO date (UTC where it names no zone), or so many hours, days or weeks before now."""
    if m := RELATIVE.fullmatch(value.strip()):
        return now - int(m[1]) * {"h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}[m[2].lower()]
    at = datetime.fromisoformat(value)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def prefix(c: Column, value: str) -> Column:
    """A prefix that ignores the case of A-Z, three-valued."""
    lower = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.startswith(lower(c), lower(F.lit(value)))


def with_call_facts(events: DataFrame) -> DataFrame:
    """tool_of and action_of (a result has its first call's), status_of (a call has its first result's)."""
    if "tool_of" in events.columns:
        return events
    key = ["run_id", "call_id"]
    linked = events.where("call_id IS NOT NULL")
    facts = linked.where("kind IN ('tool_call', 'tool_result')").groupBy(*key).agg(
        F.min_by(F.struct("tool_name", "action_kind"), F.when(F.col("kind") == "tool_call", F.struct("byte_offset", "subrecord", "id"))).alias("c"),
        F.min_by(F.struct("status"), F.when(F.col("kind") == "tool_result", F.struct("byte_offset", "subrecord", "id"))).alias("r"))
    out = events.join(facts, key, "left")
    call = F.col("kind") == "tool_call"
    return out.withColumn("tool_of", F.coalesce("tool_name", "c.tool_name")).withColumn("action_of", F.coalesce("action_kind", "c.action_kind")).withColumn("status_of", F.coalesce("status", F.when(call, F.col("r.status")))).drop("c", "r")


class Compiler:
    def __init__(self, store: Store, query: Query, now: datetime | None = None):
        self.store, self.query, self.now = store, query, now or datetime.now(UTC)
        self.names = {t.field for t in terms(query.node)}
        self.flags: dict[int, Column] = {}

    # ---- one term on the row it is a property of
    def match(self, term: Term, c: Column) -> Column:
        spec, sensitive = FIELDS[term.field], self.query.case and FIELDS[term.field].text
        if self.query.patterntype == "lexical" and term.operator == "contains" and not term.regex and spec.column == "text":
            return T.phrase(c, term.value)
        if term.regex:
            return T.matches(c, term.value, sensitive)
        return {"is": T.equals, "startswith": T.startswith, "contains": T.contains, "matches": T.matches}[term.operator](c, term.value, sensitive)

    def condition(self, term: Term) -> Column:
        spec, value = FIELDS[term.field], term.value
        name = term.field
        if name == "tag":
            return F.coalesce(F.exists("tags", lambda t: T.equals(t, value) | prefix(t, value + ":")), F.lit(False))
        c = F.col(spec.column) if spec.column else None
        if name == "at":
            if value.lower() not in ("root", "child"):
                raise QueryError("at: takes root or child", self.query.text, term.at)
            return F.col("parent_session_id" if self.query.select in ("session", "reflection") else "parent_run_id").isNull() == F.lit(value.lower() == "root")
        if name == "reflected":
            if value.lower() not in YES:
                raise QueryError("reflected: takes yes or no", self.query.text, term.at)
            return F.coalesce(F.col("has_reflection"), F.lit(False)) == F.lit(YES[value.lower()])
        if name in ("after", "before"):
            try:
                at = F.lit(moment(value, self.now))
            except ValueError as e:
                raise QueryError(f"Invalid date {value!r}; use an ISO date or 12h, 3d, 2w", self.query.text, term.at) from e
            return c >= at if name == "after" else c < at
        if name == "family":
            return F.coalesce(F.col(f"family_{abs(hash(value))}"), F.lit(False))
        if term.operator == "is":
            if name == "session":
                return prefix(c, value) | (F.col("native_id") == value)
            if name == "thread":
                return prefix(c, value)
            if name == "cwd":
                folder = os.path.expanduser(value).rstrip("/") or "/"
                return (c == folder) | prefix(c, folder.rstrip("/") + "/")
            if name == "action":
                return T.equals(c, value) | F.coalesce(F.startswith(F.lower(c), F.lit(value.lower() + ".")), F.lit(False))
            if name == "prompt":
                if value.lower().startswith("p_"):
                    return prefix(F.col("prompt_hash"), value)
                base, _, version = value.partition("@")
                return T.equals(c, base) & (F.col("prompt_version") == version) if version else T.equals(c, base)
            if name in ("asked", "schema"):
                return prefix(c, value)
            if name == "revision" and "@" not in value:
                return (c == value) | prefix(c, value + "@")
            if name == "target":
                found = (c == value) | prefix(c, value + "#") | F.coalesce(prefix(F.col("ref"), value), F.lit(False))
                kind, _, skill = value.partition(":")
                return found | prefix(c, f"skill_file:{skill}/") if kind == "skill" and skill else found
        found = self.match(term, c)
        guard = GUARDS.get(name)
        if name == "content" and self.query.internal:
            guard = None
        if guard:
            found = F.coalesce(F.expr(guard), F.lit(False)) & found
        if spec.level == "event" and spec.text and not self.query.internal and self.store.tags is not None:
            found = found & ~F.coalesce(F.exists("tags", lambda t: prefix(t, "reflection:")), F.lit(False))
        return found

    # ---- reflections and ratings side by side hold for one reflection, and one rating of it
    def reflection_rows(self, group: list[Term]) -> DataFrame:
        """Reflections that meet the group's terms."""
        rows = self.store.table("reflections")
        for t in group:
            if t.field == "coverage":
                if t.value.lower() not in ("partial", "full"):
                    raise QueryError("coverage: takes none, partial or full", self.query.text, t.at)
                covered = self.store.table("coverage").where(F.col("state") == t.value.lower()).select("session_id", "asked", "revision")
                rows = rows.join(covered, ["session_id", "asked", "revision"], "left_semi")
            elif FIELDS[t.field].level == "reflection":
                rows = rows.where(self.condition(t))
        rated = [t for t in group if FIELDS[t.field].level == "rating"]
        if rated:
            ratings = self.store.table("ratings")
            for t in rated:
                ratings = ratings.where(self.condition(t))
            rows = rows.join(ratings.select(F.col("reflection_id").alias("id")), "id", "left_semi")
        return rows

    def groups(self, node) -> list[tuple[object, list[Term]]]:
        """(where the flag stands in the tree, terms) of reflection groups."""
        is_one = lambda x: isinstance(x, Term) and FIELDS[x.field].level in ("reflection", "rating")
        if isinstance(node, And):
            own = [x for x in node.items if is_one(x)]
            return ([(node, own)] if own else []) + [g for x in node.items if not is_one(x) for g in self.groups(x)]
        if isinstance(node, Or):
            return [g for x in node.items for g in self.groups(x)]
        if isinstance(node, Not):
            return self.groups(node.item)
        return [(node, [node])] if is_one(node) else []

    def evaluate(self, node, leaf) -> Column:
        if node is None:
            return F.lit(True)
        if isinstance(node, Not):
            return ~self.evaluate(node.item, leaf)
        if isinstance(node, Or):
            out = self.evaluate(node.items[0], leaf)
            for x in node.items[1:]:
                out = out | self.evaluate(x, leaf)
            return out
        if isinstance(node, And):
            own = [x for x in node.items if isinstance(x, Term) and FIELDS[x.field].level in ("reflection", "rating")]
            parts = [self.evaluate(x, leaf) for x in node.items if x not in own] + ([self.flags[id(node)]] if own else [])
            out = parts[0]
            for x in parts[1:]:
                out = out & x
            return out
        return self.flags[id(node)] if id(node) in self.flags else leaf(node)

    def family(self, runs: DataFrame) -> DataFrame:
        wanted = {t.value for t in terms(self.query.node) if t.field == "family"}
        links = parent_links(self.store.runs) if wanted else None
        roots = tops(links) if wanted else None
        for value in wanted:
            found = family_threads(self.store.runs, self.store.sessions, value, links, roots).select("id").withColumn(f"family_{abs(hash(value))}", F.lit(True))
            runs = runs.join(found, "id", "left")
        return runs

    def rows(self) -> DataFrame:
        """The units that match, with their columns; not yet ordered."""
        q, store = self.query, self.store
        unit, all_terms = q.select, terms(q.node)
        level = lambda t: FIELDS[t.field].level
        events = store.events
        if {"tool", "action", "status"} & self.names:
            events = with_call_facts(events)
        if "shell" in self.names:
            events = events.withColumn("shell", F.when(F.col("kind") == "tool_call", F.array_join(commands(F.col("tool_name"), F.col("action_kind"), F.col("arguments"))["command"], "\n")))
        if store.tags is not None:
            events = events.join(store.tags.groupBy(F.col("event_id").alias("id")).agg(F.collect_set("tag").alias("tags")), "id", "left")
        elif "tag" in self.names:
            events = events.withColumn("tags", F.array().cast("array<string>"))
        sessions, runs = store.sessions, self.family(store.runs)
        if "reflected" in self.names:
            sessions = sessions.join(store.table("reflections").select(F.col("session_id").alias("id")).distinct().withColumn("has_reflection", F.lit(True)), "id", "left")
        base = {"event": events, "thread": runs, "session": sessions, "reflection": store.table("reflections")}[unit]

        flagged: dict[int, str] = {}
        # own columns of the unit's thread and session, renamed out of each other's way
        if unit in ("event", "thread", "reflection"):
            need = [t for t in all_terms if level(t) == "session"]
            s = sessions.select(F.col("id").alias("session_id"), F.col("started_at").alias("session_started_at"), *(self.condition(t).alias(f"t{i}") for i, t in enumerate(all_terms) if t in need))
            for i, t in enumerate(all_terms):
                if t in need:
                    flagged[id(t)] = f"t{i}"
            base = base.join(s, "session_id")
        lifted: dict[str, list[tuple[int, Term]]] = {"event": [], "thread": []}
        for i, t in enumerate(all_terms):
            if level(t) in lifted and level(t) != unit and not (t.field == "at" and unit in ("session", "reflection")):
                lifted[level(t)].append((i, t))
        if unit == "event":
            found = lifted.pop("thread")
            r = runs.select(F.col("id").alias("run_id"), *(self.condition(t).alias(f"t{i}") for i, t in found))
            base = base.join(r, "run_id")
            flagged |= {id(t): f"t{i}" for i, t in found}
            lifted = {}
        for kind, found in lifted.items():
            if not found:
                continue
            source, key = (events, UNIT_KEY[unit]) if kind == "event" else (runs, "session_id")
            flags = source.select(F.col(key).alias("unit_key"), *(self.condition(t).alias(f"t{i}") for i, t in found)).groupBy("unit_key").agg(*(F.bool_or(f"t{i}").alias(f"t{i}") for i, _ in found))
            base = base.join(flags, base["session_id" if unit == "reflection" else "id"] == flags["unit_key"], "left").drop("unit_key")
            flagged |= {id(t): f"t{i}" for i, t in found}
        for k, (at, group) in enumerate(self.groups(q.node)):
            coverage = [t for t in group if t.field == "coverage"]
            if len(coverage) > 1:
                raise QueryError("coverage: given twice for one reflection", q.text, coverage[1].at)
            none = bool(coverage) and coverage[0].value.lower() == "none"
            found = self.reflection_rows([t for t in group if not (none and t.field == "coverage")])
            if unit == "reflection":
                hit = found.select("id").distinct().withColumn(f"g{k}", F.lit(True))
                base = base.join(hit, "id", "left")
                flag = F.lit(False) if none else F.coalesce(F.col(f"g{k}"), F.lit(False))
            else:
                key = "id" if unit == "session" else "session_id"
                hit = found.select(F.col("session_id").alias("hit_session")).distinct().withColumn(f"g{k}", F.lit(True))
                base = base.join(hit, base[key] == hit["hit_session"], "left").drop("hit_session")
                flag = F.coalesce(F.col(f"g{k}"), F.lit(False))
                flag = ~flag if none else flag
            self.flags[id(at)] = flag

        def leaf(t: Term) -> Column:
            if id(t) in flagged:
                c = F.col(flagged[id(t)])
                return F.coalesce(c, F.lit(False)) if level(t) in ("event", "thread") and unit != "event" else c
            return self.condition(t)

        kept = base.where(self.evaluate(q.node, leaf))
        drop = [c for c in kept.columns if re.fullmatch(r"[tg]\d+|family_\d+|has_reflection", c)]
        return kept.drop(*drop)


def run(store: Store, text: str | Query, *, now: datetime | None = None, limit: int | None = None, offset: int = 0, default_limit: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """The units a query selects, in order.

    limit: at most so many, before the query's own ``count:`` and ``default_limit``.  within: event ids to which the
    query is restricted.  Lexical event queries order by relevance, everything else newest session first.
    """
    from ..operators.search import bm25

    query = parse(text) if isinstance(text, str) else text
    if within is not None:
        events = store.events.join(within.select("id"), "id", "left_semi")
        sessions = store.sessions.join(events.select(F.col("session_id").alias("id")), "id", "left_semi")
        store = Store(events, sessions, store.runs.join(events.select(F.col("run_id").alias("id")), "id", "left_semi"), store.reflections, store.ratings, store.coverage, store.tags)
    rows = Compiler(store, query, now).rows()
    newest = F.desc_nulls_last("session_started_at")
    if query.select == "event":
        order = [newest, "source_id", "session_id", "path", "byte_offset", "subrecord", "id"]
        ranked = [t for t in required(query.node) if query.patterntype == "lexical" and t.operator == "contains" and not t.regex and FIELDS[t.field].column == "text"]
        if ranked:
            scores = bm25(store.events, [w for t in ranked for w in T.plain_words(t.value)], key="id", text="text")
            rows = rows.join(scores, "id", "left")
            order = [F.desc_nulls_last("score"), *order]
    elif query.select == "thread":
        order = [newest, F.asc_nulls_first("started_at"), "id"]
    elif query.select == "session":
        order = [F.desc_nulls_last("started_at"), "id"]
    else:
        order = [F.desc_nulls_last("at"), "id"]
    limit = limit or query.count or default_limit
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit else rows


def match_ranges(query: str | Query, c: Column) -> Column:
    """Spans (code points, merged) of a text that the query's positive patterns matched."""
    import pyarrow as pa

    query = parse(query) if isinstance(query, str) else query
    found = [t for t in positive(query.node) if FIELDS[t.field].column == "text"]
    lexical = query.patterntype == "lexical"

    def spans(text: str) -> list[tuple[int, int]]:
        out = []
        for t in found:
            if lexical and t.operator == "contains" and not t.regex:
                out += [r for w in re.findall(r"\w+", t.value) for r in T.literal_ranges(text, w, False)]
            elif t.regex:
                out += [m.span() for m in re.finditer(t.value, text, 0 if query.case else re.I) if m.end() > m.start()]
            elif t.operator == "contains":
                out += T.literal_ranges(text, t.value, query.case)
            elif t.operator == "startswith":
                start = len(text) - len(text.lstrip())
                out.append((start, start + len(t.value)))
            elif t.operator == "is":
                out.append((0, len(text)))
        return T.merged(out)

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def ranges(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [{"start": a, "end": b} for a, b in spans(x)] for x in v.to_pylist()], kind)

    return ranges(c)
