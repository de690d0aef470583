"""Cases for process mining: canonical rows, labelled actions, abstract states, outcomes, failure findings.

Everything is windows and conditional aggregates over a case's rows in order (``seq``); cases never mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import command_family, file_kind, significant_part
from ..functions.shell import commands
from ..model import ORDER
from .checkpoint import cut
from .traversal import tree_paths

#: How texts are told apart.
META = r"(?i)^\s*(<(command-|local-command|system-reminder|environment_context|user_instructions|recommended_plugins|app-context|permissions)|caveat:|# agents\.md|base directory for this skill)"
ABORT = r"(?i)^\s*(\[request interrupted|stop\b|abort\b|cancel\b|never ?mind\b|forget it\b)"
CORRECTION = r"(?i)^\s*(no\b|nope\b|wrong\b|that'?s not|that is not|not what|don'?t\b|do not\b|instead\b|actually\b|revert\b|undo\b|why did you|you (should|shouldn'?t|didn'?t|forgot)|wait\b|hmm\b)|\binstead of\b"
APPROVE = r"(?i)^\s*(ok(ay)?|yes|yep|yeah|good|great|perfect|lgtm|looks good|thanks?|thank you|nice|go ahead|do it|proceed|ship it|approved?|sure|correct|exactly)\b"
CONTINUE = r"(?i)^\s*(continue|go on|keep going|next|resume|carry on)\b"
TASK = r"(?i)^\s*(add|implement|create|make|write|build|fix|refactor|change|update|remove|delete|rename|let'?s|lets|can (we|you)|could (we|you)|please|i (want|would like|need)|now)\b"
QUESTION = r"(?i)^\s*(what|why|how|where|which|who|when|is|are|does|do|can|could|should|will)\b"
PLAN = r"(?i)^\s*(i'?ll\b|i will\b|let me\b|let's\b|plan\b|first[,:]|next[,:]|now\b|step \d|1[.)]\s|i'?m going to|going to)"
FAILED_START = r"(?i)^\s*(exit code [1-9]|error\b|traceback \(most recent call last\)|fatal:|<tool_use_error>|command not found|permission denied|no such file or directory)"
ERROR_LINE = r"(?i)(traceback \(most recent call last\)|\w*(error|exception)\b|\bfailed\b|\bfatal\b|not found|denied|exit code [1-9]|assert)"
API_ERROR = r"(?i)^\s*(api error|request failed|rate limit|overloaded|internal server error)"
CLAIM = r"(?i)(all (\d+ )?tests? (now )?pass|tests? (are |now )?(all )?passing|(now )?pass(es)? (all|now)|\bfixed\b|\bresolved\b|works now|is now working|successfully|everything (works|passes)|✅|build (is |now )?(green|passing|succeeds))"
INVALID = r"(?i)(<tool_use_error>|no such tool|inputvalidationerror|invalid (arguments?|parameters?|input)|unknown (tool|parameter|argument)|missing required (parameter|argument)|unexpected (keyword )?argument|is not a valid)"
GUARDRAIL = r"(?i)(requires? (approval|permission)|permission denied|operation not permitted|not permitted|sandbox|blocked by|denied by|user (rejected|denied)|doesn'?t want to proceed|approval (was )?(denied|rejected)|not allowed)"
SYSTEM = r"(?i)(timed? ?out|rate.?limit|overloaded|econnreset|connection (reset|refused)|\b50[234]\b|internal server error|service unavailable|api error)"
#: Tools by label, phases of label families.
EXPLORERS = ("read", "grep", "glob", "ls", "list_dir", "find", "view", "search", "codebase_search")
EDITORS = ("edit", "write", "multiedit", "apply_patch", "notebookedit", "str_replace_editor")
TOOLS = {"DELEGATE": ("task", "agent", "spawn_agent"), "PLAN": ("todowrite", "update_plan", "exitplanmode", "enterplanmode"), "ASK_USER": ("askuserquestion", "ask_user", "request_user_input"), "WEB": ("webfetch", "websearch", "web_search", "fetch", "browse"), "SKILL": ("skill",)}
PHASES = {"EXPLORE": "EXPLORE", "WEB": "EXPLORE", "SKILL": "EXPLORE", "EDIT": "EDIT", "TEST": "TEST", "BUILD": "VERIFY", "RUN": "VERIFY", "GIT": "VERIFY", "INSTALL": "SETUP", "SHELL": "OTHER", "TOOL": "OTHER", "DELEGATE": "DELEGATE", "PLAN": "PLAN", "ASK_USER": "ASK_USER", "USER": "USER_TURN", "FINAL_SUMMARY": "DONE", "COMPACT": "COMPACT", "API_ERROR": "ERROR"}
PATH_KEYS = ("file_path", "path", "filePath", "notebook_path", "target_file", "AbsolutePath", "TargetFile")
QUIET, CHECKS = ("THINK", "MODEL", "EXPLAIN"), ("TEST", "BUILD", "RUN")
FAILURES = ("abandoned", "user_aborted", "error", "branch_abandoned")


def _json(path: str) -> Column:
    return F.get_json_object("raw", path)


def canonical(events: DataFrame) -> DataFrame:
    """Rows worth analysing, by ``row_kind``; tool calls with command and paths, results with status and error lines,
    token usage of the four shapes that harnesses record."""
    number = lambda *paths: sum((F.coalesce(_json(p).try_cast("bigint"), F.lit(0)) for p in paths), F.lit(0))
    tokens_in = number("$.message.usage.input_tokens", "$.message.usage.cache_read_input_tokens", "$.message.usage.cache_creation_input_tokens", "$.message.usage.input", "$.message.usage.cacheRead", "$.message.usage.cacheWrite", "$.payload.info.last_token_usage.input_tokens", "$.info.tokens.input")
    tokens_out = number("$.message.usage.output_tokens", "$.message.usage.output", "$.payload.info.last_token_usage.output_tokens", "$.info.tokens.output")
    cost = F.coalesce(_json("$.message.usage.cost.total").try_cast("double"), _json("$.info.cost").try_cast("double"), F.lit(0.0))
    native = F.coalesce(F.col("native_type"), _json("$.type"), F.lit(""))
    speaks = (F.col("kind") == "message") & (F.col("role") == "assistant")
    text = F.coalesce("text", F.lit(""))
    broken = (_json("$.isApiErrorMessage") == "true") | _json("$.payload.type").isin("error", "stream_error") | (speaks & text.rlike(API_ERROR))
    changed = F.when(native == "turn_context", _json("$.payload.model")).when(native == "model_change", F.coalesce(_json("$.modelId"), _json("$.model"), _json("$.to"), F.lit("unknown")))
    compact = F.lower(F.concat_ws(" ", native, _json("$.type"), _json("$.subtype"), _json("$.payload.type"))).contains("compact") | (_json("$.isCompactSummary") == "true")
    kind = (F.when(F.coalesce(broken, F.lit(False)), "api_error").when((F.col("kind") == "message") & (F.col("role") == "user"), "user_msg").when(speaks, "assistant_text")
            .when(F.col("kind") == "message", None).when(F.col("kind").isin("thinking", "tool_call", "tool_result"), F.col("kind")).when(changed.isNotNull(), "model_change")
            .when(F.coalesce(compact, F.lit(False)) | (F.col("kind") == "compaction"), "compaction").when(tokens_in + tokens_out > 0, "usage"))
    patch = F.regexp_extract_all(F.coalesce(F.get_json_object("arguments", "$.input"), F.get_json_object("arguments", "$.patch"), F.get_json_object("arguments", "$.content"), F.col("arguments"), F.lit("")), F.lit(r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.+)$"), F.lit(1))
    keyed = F.filter(F.array(*(F.get_json_object("arguments", f"$.{k}") for k in PATH_KEYS)), lambda x: x.isNotNull())
    paths = F.array_distinct(F.filter(F.transform(F.concat(keyed, patch), F.trim), lambda x: x != ""))
    call = kind == "tool_call"
    errors = F.slice(F.transform(F.filter(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: x.rlike(ERROR_LINE)), lambda x: F.substring(F.trim(x), 1, 200)), 1, 5)
    status = F.when((F.col("status") == "failure") | (F.col("status").isNull() & F.substring(text, 1, 500).rlike(FAILED_START)), "fail").otherwise("ok")
    out = events.withColumns({"row_kind": kind, "tokens": tokens_in + tokens_out, "cost": cost, "model": F.coalesce(changed, _json("$.message.model"), _json("$.info.modelID")), "paths": F.when(call, paths), "result_status": F.when(kind == "tool_result", status), "error_text": F.when(kind == "tool_result", F.array_join(errors, "\n"))}).where("row_kind IS NOT NULL")
    found = F.when(F.col("row_kind") == "tool_call", commands(F.col("tool_name"), F.col("action_kind"), F.col("arguments")))
    return out.withColumn("command", F.nullif(F.array_join(found["command"], "\n"), F.lit("")))


def case_rows(events: DataFrame) -> DataFrame:
    """Canonical rows by case: one for each run, or for each root-to-leaf path of a run whose records form a tree with
    forks; ``abandoned_branch`` marks paths that don't end in the run's last record.  Usage that several records of one
    reply repeat counts once; the model in force is carried forward."""
    rows = canonical(events)
    tree = events.where("native_id IS NOT NULL AND parent_native_id IS NOT NULL")
    forked = tree.groupBy("run_id", "parent_native_id").agg(F.countDistinct("native_id").alias("n")).where("n > 1").select("run_id").distinct()
    nodes = events.where("native_id IS NOT NULL").join(forked, "run_id", "left_semi").groupBy(F.col("run_id").alias("group"), F.col("native_id").alias("id")).agg(F.max("parent_native_id").alias("parent"), F.min("byte_offset").alias("ord"))
    paths = tree_paths(nodes).select(F.col("group").alias("run_id"), "leaf", "last", F.explode("path").alias("native_id"))
    plain = rows.join(forked, "run_id", "left_anti").withColumn("case_id", F.col("run_id")).withColumn("abandoned_branch", F.lit(False))
    branched = rows.join(paths, ["run_id", "native_id"]).withColumn("case_id", F.concat_ws("/", "run_id", "leaf")).withColumn("abandoned_branch", ~F.col("last")).select(plain.columns)
    w = Window.partitionBy("case_id").orderBy(*ORDER)
    out = plain.unionByName(branched).withColumn("seq", F.row_number().over(w))
    reply = F.coalesce(_json("$.message.id"), F.col("native_id"))
    first = F.row_number().over(Window.partitionBy("case_id", reply).orderBy("seq")) == 1
    once = F.col("row_kind").eqNullSafe("usage") | reply.isNull() | first
    carried = F.last("model", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("tokens", F.when(once, F.col("tokens")).otherwise(0)).withColumn("cost", F.when(once, F.col("cost")).otherwise(0.0)).withColumn("model", carried)


def target_kind(paths: Column, none: str) -> Column:
    kinds = F.transform(paths, file_kind)
    out = F.when(F.coalesce(F.size(paths), F.lit(0)) <= 0, none)
    for kind in ("test", "src", "config", "docs"):
        out = out.when(F.array_contains(kinds, kind), kind)
    return out.otherwise("other")


def call_label(command: Column, action: Column, tool: Column, paths: Column) -> Column:
    """What a tool call does: EXPLORE:src, EDIT:test, TEST, GIT, DELEGATE ..."""
    name = F.element_at(F.split(F.lower(F.coalesce(tool, F.lit(""))), "__"), -1)
    action = F.coalesce(action, F.lit(""))
    family = command_family(command)
    words = F.slice(F.filter(F.split(command, r"\s+"), lambda x: x.contains("/") | x.rlike(r"\.\w{1,5}$")), 1, 5)
    seen = F.when(F.size(paths) > 0, paths).otherwise(words)
    shell = F.when(family == "search", F.concat(F.lit("EXPLORE:"), target_kind(seen, "code"))).when(family == "edit", F.concat(F.lit("EDIT:"), target_kind(seen, "code")))
    for f in ("test", "build", "install", "git", "run"):
        shell = shell.when(family == f, f.upper())
    out = F.when(command.isNotNull(), shell.otherwise("SHELL"))
    out = out.when(action.rlike(r"^(file\.read|search\.)") | name.isin(*EXPLORERS), F.concat(F.lit("EXPLORE:"), target_kind(paths, "code")))
    out = out.when(action.rlike(r"^file\.(write|patch)") | name.isin(*EDITORS), F.concat(F.lit("EDIT:"), target_kind(paths, "src")))
    out = out.when(F.startswith(action, F.lit("agent.")), "DELEGATE")
    for label, names in TOOLS.items():
        out = out.when(name.isin(*names), label)
    return out.when(F.startswith(F.coalesce(tool, F.lit("")), F.lit("mcp__")), "TOOL:mcp").otherwise("TOOL")


def user_intent(text: Column, first: Column) -> Column:
    n = F.length(text)
    return (F.when(text.rlike(ABORT), "ABORT").when(first, "TASK_NEW").when(F.substring(text, 1, 200).rlike(CORRECTION), "CORRECTION").when((n <= 160) & text.rlike(CONTINUE), "CONTINUE")
            .when((n <= 160) & text.rlike(APPROVE) & ~F.substring(text, 21, 100).rlike(TASK), "APPROVE").when(text.rlike(TASK) | (n > 400), "TASK_NEW").when(text.rlike(r"\?\s*$") | (text.rlike(QUESTION) & (n < 300)), "QUESTION").otherwise("CLARIFY"))


def assistant_kind(text: Column, last: Column) -> Column:
    return F.when(last, "FINAL_SUMMARY").when(F.substring(text, -200, 200).contains("?"), "ASK_USER").when(text.rlike(PLAN), "PLAN").otherwise("EXPLAIN")


def actions(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Labelled steps ``case_id, idx, label, family, outcome, tokens ...``: calls joined with their last result, messages
    labelled, usage given to the step it was spent on.  ``overrides``: (text, label) that replace the rules."""
    case = Window.partitionBy("case_id")
    w = case.orderBy("seq")
    text = F.trim(F.coalesce("text", F.lit("")))
    kind = F.col("row_kind")
    said = (kind == "assistant_text") & (text != "")
    rows = rows.withColumn("t", text).withColumn("last_said", F.max(F.when(said, F.col("seq"))).over(case)).withColumn("last_call", F.max(F.when(kind == "tool_call", F.col("seq"))).over(case))
    repeat = F.row_number().over(Window.partitionBy("case_id", "row_kind", "call_id").orderBy("seq")) > 1
    keep = F.when(kind == "user_msg", (F.col("t") != "") & ~F.col("t").rlike(META)).when(kind == "assistant_text", F.col("t") != "").when((kind == "tool_call") & F.col("call_id").isNotNull(), ~repeat).otherwise(True)
    results = rows.where("row_kind = 'tool_result' AND call_id IS NOT NULL").groupBy("case_id", "call_id").agg(F.max_by(F.struct("seq", "result_status", "error_text", "text", "id"), "seq").alias("r"))
    steps = rows.withColumn("keep", keep).where("keep AND row_kind <> 'tool_result'")
    sample = F.substring("t", 1, 160)
    same = (kind == "user_msg") & (F.lag("row_kind").over(w) == "user_msg") & (F.lag(sample).over(w) == sample)
    spent = F.col("row_kind") == "usage"
    steps = steps.withColumn("sample", sample).withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same")
    n = F.sum((~spent).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("idx", F.greatest(n, F.lit(1)) - 1)
    usage = steps.groupBy("case_id", "idx").agg(F.sum("tokens").alias("spent_tokens"), F.sum("cost").alias("spent_cost"))
    steps = steps.where(~spent).drop("tokens", "cost").join(usage, ["case_id", "idx"]).withColumnsRenamed({"spent_tokens": "tokens", "spent_cost": "cost"})
    first = F.row_number().over(Window.partitionBy("case_id", "row_kind").orderBy("seq")) == 1
    last = (F.col("seq") == F.col("last_said")) & (F.coalesce("last_call", F.lit(0)) < F.col("seq"))
    user, assistant = user_intent(F.col("t"), first), assistant_kind(F.col("t"), last)
    if overrides is not None:
        steps = steps.join(overrides.select(F.col("text").alias("t"), F.col("label").alias("given")), "t", "left")
        user, assistant = F.coalesce("given", user), F.when(last, "FINAL_SUMMARY").otherwise(F.coalesce("given", assistant))
    label = (F.when(kind == "user_msg", F.concat(F.lit("USER:"), user)).when(kind == "assistant_text", assistant).when(kind == "thinking", "THINK").when(kind == "compaction", "COMPACT")
             .when(kind == "model_change", "MODEL").when(kind == "api_error", "API_ERROR").otherwise(call_label(F.col("command"), F.col("action_kind"), F.col("tool_name"), F.col("paths"))))
    steps = steps.withColumn("base", label).withColumn("family", F.split_part("base", F.lit(":"), F.lit(1))).join(results, ["case_id", "call_id"], "left")
    paired = (kind == "tool_call") & (F.col("r.seq") > F.col("seq"))
    outcome = F.when(paired, F.col("r.result_status"))
    shown = F.when(F.col("family").isin("EXPLORE", "EDIT"), F.when(outcome == "fail", F.concat("base", F.lit(":fail"))).otherwise(F.col("base"))).when(outcome.isNotNull() & ~F.col("family").isin("USER", "THINK", "MODEL", "COMPACT"), F.concat_ws(":", "base", outcome)).otherwise(F.col("base"))
    sample = F.when(kind == "tool_call", F.substring(F.coalesce(F.when(F.col("command").isNotNull(), significant_part(F.col("command"))), F.nullif(F.array_join("paths", ", "), F.lit("")), F.col("arguments")), 1, 160)).otherwise(F.col("sample"))
    called = F.coalesce("command", F.concat_ws(" ", "tool_name", "arguments"))
    return steps.select("case_id", "session_id", "run_id", "parent_run_id", "abandoned_branch", "idx", shown.alias("label"), "family", outcome.alias("outcome"), sample.alias("sample"), F.when(kind == "tool_call", called).alias("called"), F.col("t").alias("text"), "tool_name", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), "tokens", "cost", "model", F.col("ts_text").alias("start"), F.when(paired, F.concat_ws("\n", "r.error_text", F.substring("r.text", 1, 500))).alias("result_text"), F.array_compact(F.array("id", F.when(paired, F.col("r.id")))).alias("event_ids"))


def states(steps: DataFrame, abstraction: str = "phase+outcome") -> DataFrame:
    """Abstract states ``case_id, pos, name, repeat, first`` under ``phase``, ``phase+outcome``, ``tail:K`` or ``label``."""
    from .mining import collapse

    w = Window.partitionBy("case_id").orderBy("idx")
    if abstraction == "label":
        named = steps.where("family NOT IN ('THINK', 'MODEL')").withColumn("name", F.col("label"))
    else:
        kept = steps.where(~F.col("family").isin(*QUIET))
        base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv)), F.col("family")), F.lit("OTHER"))
        trouble = F.max((F.col("outcome") == "fail").cast("int")).over(w.rowsBetween(-3, -1)) == 1
        kept = kept.withColumn("base", base).withColumn("phase", F.when(F.col("base").isin("EXPLORE", "VERIFY", "OTHER", "SETUP") & F.coalesce(trouble, F.lit(False)), "DEBUG").otherwise(F.col("base")))
        fine = (F.when(F.col("phase") == "USER_TURN", F.concat(F.lit("USER_TURN:"), F.split_part("label", F.lit(":"), F.lit(2)))).when(F.col("outcome").isNull(), F.col("phase"))
                .when(F.col("phase").isin("TEST", "VERIFY", "SETUP", "OTHER"), F.concat_ws(":", "phase", "outcome")).when(F.col("outcome") == "fail", F.concat("phase", F.lit(":fail"))).otherwise(F.col("phase")))
        if abstraction == "phase":
            named = kept.withColumn("name", F.col("phase"))
        elif abstraction == "phase+outcome":
            named = kept.withColumn("name", fine)
        elif abstraction.startswith("tail:") and abstraction[5:].isdigit() and 1 <= int(abstraction[5:]) <= 5:
            named = kept.withColumn("fine", fine).withColumn("name", F.array_join(F.collect_list("fine").over(w.rowsBetween(1 - int(abstraction[5:]), 0)), " > "))
        else:
            raise ValueError("use phase, phase+outcome, label or tail:1 to tail:5")
    return collapse(named, order=("idx",))


def outcomes(steps: DataFrame) -> DataFrame:
    """``case_id, outcome``: error, branch_abandoned, abandoned, user_aborted or completed."""
    meaningful = ~F.col("family").isin(*QUIET, "COMPACT")
    idx = F.when(meaningful, F.col("idx"))
    late = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc_nulls_last(idx)))
    rows = steps.withColumn("m", meaningful).withColumn("late", late).withColumn("edit", F.max(F.when(F.col("family") == "EDIT", F.col("idx"))).over(Window.partitionBy("case_id")))
    check = F.col("family").isin(*CHECKS) & F.col("outcome").isNotNull() & (F.col("idx") > F.coalesce("edit", F.lit(-1)))
    facts = rows.groupBy("case_id").agg(F.bool_or(F.col("m") & (F.col("late") <= 3) & (F.col("family") == "API_ERROR")).alias("error"), F.max("abandoned_branch").alias("branch"), F.max_by(F.when(F.col("m"), F.col("label")), F.when(F.col("m"), F.col("idx"))).alias("label"), F.max_by("outcome", F.when(check, F.col("idx"))).alias("check"))
    outcome = (F.when(F.col("error"), "error").when(F.col("branch"), "branch_abandoned").when(F.col("label").isNull(), "abandoned").when(F.col("label").isin("USER:ABORT", "USER:CORRECTION"), "user_aborted").when(F.col("label") == "USER:APPROVE", "completed")
               .when(~F.startswith("label", F.lit("FINAL_SUMMARY")), "abandoned").when(F.col("check") == "fail", "abandoned").otherwise("completed"))
    return facts.select("case_id", outcome.alias("outcome"))


FINDING = ["case_id", "idx", "mode", "confidence", "evidence"]


def _finding(rows: DataFrame, mode, confidence: str, evidence: Column) -> DataFrame:
    return rows.select("case_id", F.col("idx").cast("bigint").alias("idx"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"), F.lit(confidence).alias("confidence"), F.substring(evidence, 1, 300).alias("evidence"))


def findings(steps: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Failure findings by rule: ``case_id, idx, mode, confidence, evidence``.  ``results``: outcomes, for delegation."""
    steps = cut(steps)  # every rule reads them
    case = Window.partitionBy("case_id")
    w = case.orderBy("idx")
    fam, idx = F.col("family"), F.col("idx")
    text = F.coalesce("result_text", F.lit(""))
    kind = F.when(text.rlike(INVALID), "invalid_invocation").when(text.rlike(GUARDRAIL), "guardrail_block").when(text.rlike(SYSTEM), "system_failure")
    rows = steps.withColumn("trouble", F.when(F.col("outcome") == "fail", kind))
    out = [_finding(rows.where(fam == "API_ERROR"), "system_failure", "high", F.concat(F.lit("API error: "), "sample")), _finding(rows.where(F.col("trouble").isNotNull() & (fam != "API_ERROR")), F.col("trouble"), "high", F.concat_ws(": ", "label", "sample"))]

    # checks between the last edit of code and the final answer
    said = ~fam.isin(*QUIET, "COMPACT")
    r = rows.withColumn("final", F.max(F.when(said, idx)).over(case)).withColumn("edit", F.max(F.when((fam == "EDIT") & ~F.startswith("label", F.lit("EDIT:docs")), idx)).over(case))
    ran = fam.isin(*CHECKS) & F.col("trouble").isNull() & (idx > F.col("edit")) & (idx < F.col("final"))
    facts = r.groupBy("case_id").agg(F.max("final").alias("idx"), F.max("edit").alias("edit"), F.max_by("family", F.when(idx == F.col("final"), idx)).alias("last"), F.max_by("text", F.when(idx == F.col("final"), idx)).alias("answer"), F.count_if(ran).alias("checks"), F.max_by(F.struct("label", "outcome"), F.when(ran & F.col("outcome").isNotNull(), idx)).alias("c"))
    ended = facts.where((F.col("last") == "FINAL_SUMMARY") & F.col("edit").isNotNull())
    bad = ended.where(F.col("c.outcome") == "fail")
    out += [_finding(ended.where("checks = 0"), "no_verification", "high", F.concat(F.lit("last edit at step "), F.col("edit").cast("string"))), _finding(bad, "premature_done", "high", F.col("c.label")), _finding(bad.where(F.col("answer").rlike(CLAIM)), "claim_contradicted", "high", F.concat(F.lit("the final answer says "), F.regexp_extract("answer", CLAIM, 0)))]
    # a passing check that the user corrects before the next edit or check
    event = F.when(fam.isin("EDIT", *CHECKS), F.struct(idx.alias("i"), F.lit(0).alias("c"))).when(F.col("label") == "USER:CORRECTION", F.struct(idx.alias("i"), F.lit(1).alias("c")))
    nxt = F.first(event, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    passed = rows.withColumn("n", nxt).where(fam.isin("TEST", "BUILD") & (F.col("outcome") == "ok") & (F.col("n.c") == 1))
    out.append(_finding(passed.withColumn("idx", F.col("n.i")), "incorrect_verification", "medium", F.concat_ws(": ", "label", "sample")))
    # the same call three times without an edit between
    epoch = F.sum(((fam == "EDIT") & ~F.coalesce(F.col("outcome") == "fail", F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    calls = rows.withColumn("epoch", epoch).where(F.col("tool_name").isNotNull() & (F.coalesce(F.trim("sample"), F.lit("")) != "") & ~((fam == "EDIT") & ~F.coalesce(F.col("outcome") == "fail", F.lit(False))) & ~((fam == "EXPLORE") & ~F.coalesce(F.col("outcome") == "fail", F.lit(False))))
    same = calls.groupBy("case_id", "epoch", "label", "called", "outcome").agg(F.min("idx").alias("idx"), F.count("*").alias("n"), F.min_by("sample", "idx").alias("sample")).where("n >= 3")
    out.append(_finding(same, "step_repetition", "high", F.concat(F.concat_ws(" ", "label", "sample"), F.lit(" "), F.col("n").cast("string"), F.lit("x"))))
    # a short first task, edited on at once, then corrected
    after = w.rowsBetween(1, Window.unboundedFollowing)
    step = F.struct(idx.alias("i"), fam.alias("f"), F.col("label").alias("l"))
    task = rows.withColumn("stop", F.first(F.when(fam.isin("EDIT", "USER"), step), ignorenulls=True).over(after)).withColumn("look", F.min(F.when(fam.isin("EXPLORE", "ASK_USER", "WEB"), idx)).over(after)).withColumn("user", F.first(F.when(fam == "USER", step), ignorenulls=True).over(after)).withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "label").orderBy("idx")))
    short = task.where((F.col("label") == "USER:TASK_NEW") & (F.col("nth") == 1) & (F.size(F.split(F.trim("text"), r"\s+")) < 15) & (F.col("stop.f") == "EDIT") & ~F.coalesce(F.col("look") < F.col("stop.i"), F.lit(False)) & (F.col("user.l") == "USER:CORRECTION"))
    out.append(_finding(short.withColumn("idx", F.col("stop.i")), "failed_to_clarify", "low", F.col("sample")))
    # files read again soon after a compaction
    reads = rows.where(fam == "EXPLORE").select("case_id", F.col("idx").alias("at"), F.explode("paths").alias("path"))
    compact = rows.where(fam == "COMPACT").select("case_id", F.col("idx").alias("cut"))
    near = compact.select("case_id", "cut", F.explode(F.sequence(F.col("cut") + 1, F.col("cut") + 10)).alias("at"))
    first_read = reads.groupBy("case_id", "path").agg(F.min("at").alias("first_at"))
    again = near.join(reads, ["case_id", "at"]).join(first_read, ["case_id", "path"]).where("first_at < cut").groupBy("case_id", "cut").agg(F.min("at").alias("idx"), F.countDistinct("path").alias("files")).where("files >= 2")
    out.append(_finding(again, "history_loss", "low", F.concat(F.lit("files read again: "), F.col("files").cast("string"))))
    if results is not None:
        run = steps.groupBy("case_id").agg(F.max("run_id").alias("run_id"), F.max("parent_run_id").alias("parent_run_id")).join(results, "case_id")
        lost = run.where(F.col("outcome").isin(*FAILURES) & F.col("parent_run_id").isNotNull()).groupBy(F.col("parent_run_id").alias("run_id")).agg(F.count("*").alias("n"))
        done = run.where("outcome = 'completed'").join(lost, "run_id").join(facts.where("last = 'FINAL_SUMMARY'").select("case_id", "idx"), "case_id")
        out.append(_finding(done, "delegation_failed", "medium", F.concat(F.lit("failed delegated cases: "), F.col("n").cast("string"))))
    return reduce(DataFrame.unionByName, out)


def critical_steps(steps: DataFrame, results: DataFrame, found: DataFrame) -> DataFrame:
    """``case_id, outcome, idx, label, category`` of each failed case: where its last run of unrecovered failures began,
    else the step before the intervention, else its last step."""
    case = Window.partitionBy("case_id")
    ahead = case.orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    failed = (F.coalesce(F.col("outcome") == "fail", F.lit(False))) | (F.col("family") == "API_ERROR")
    rows = steps.join(results.withColumnRenamed("outcome", "ended").where(F.col("ended").isin(*FAILURES)), "case_id").withColumn("failed", failed)
    approve = F.max((F.col("label") == "USER:APPROVE").cast("int")).over(ahead)
    family = Window.partitionBy("case_id", "family").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    better = F.max((~F.col("failed")).cast("int")).over(family)
    active = F.max((~F.col("family").isin(*QUIET, "API_ERROR", "USER")).cast("int")).over(ahead)
    recovered = (F.coalesce(approve, F.lit(0)) == 1) | F.when(F.col("family") == "API_ERROR", F.coalesce(active, F.lit(0)) == 1).otherwise(F.coalesce(better, F.lit(0)) == 1)
    rows = rows.withColumn("open", F.col("failed") & ~recovered).withColumn("last_open", F.max(F.when(F.col("open"), F.col("idx"))).over(case))
    breaks = F.col("family").isin("EDIT", *CHECKS) & ~F.col("failed") & (F.col("idx") < F.col("last_open"))
    rows = rows.withColumn("break_at", F.max(F.when(breaks, F.col("idx"))).over(case)).withColumn("turn", F.max(F.when(F.col("label").isin("USER:CORRECTION", "USER:ABORT"), F.col("idx"))).over(case))
    loud = ~F.col("family").isin(*QUIET)
    facts = rows.groupBy("case_id").agg(F.max("ended").alias("outcome"), F.min(F.when(F.col("open") & (F.col("idx") > F.coalesce("break_at", F.lit(-1))), F.col("idx"))).alias("start"), F.max("turn").alias("turn"), F.max(F.when(loud & (F.col("idx") < F.col("turn")), F.col("idx"))).alias("before"), F.coalesce(F.max(F.when(loud, F.col("idx"))), F.max("idx")).alias("final"))
    stopped = (F.col("outcome") == "user_aborted") & F.col("turn").isNotNull()
    at = F.coalesce("start", F.when(stopped, F.coalesce("before", "turn")), F.col("final"))
    picked = facts.select("case_id", F.col("outcome").alias("ended"), at.alias("idx"), F.when(F.col("start").isNotNull(), "failure").when(stopped, "user_intervention").otherwise("no_final_answer").alias("why"))
    modes = found.groupBy("case_id", "idx").agg(F.collect_set("mode").alias("modes"))
    out = picked.join(steps, ["case_id", "idx"]).join(modes, ["case_id", "idx"], "left")
    has = lambda m: F.coalesce(F.array_contains("modes", m), F.lit(False))
    category = (F.when(F.col("why") != "failure", F.col("why")).when((F.col("family") == "API_ERROR") | has("system_failure"), "system_failure").when(has("invalid_invocation"), "invalid_invocation").when(has("guardrail_block"), "guardrail")
                .when(F.col("family").isin(*CHECKS), "check_failed").when(F.col("family") == "EDIT", "edit_failed").when(F.col("family") == "EXPLORE", "exploration_failed").otherwise("tool_failed"))
    return out.select("case_id", F.col("ended").alias("outcome"), "idx", "label", category.alias("category"), "sample")


def mode_table(found: DataFrame, results: DataFrame) -> DataFrame:
    """Per mode: findings, cases, and the shares of failed and completed cases that have it."""
    totals = results.agg(F.count_if(F.col("outcome") != "completed").alias("failed"), F.count_if(F.col("outcome") == "completed").alias("completed"))
    j = found.join(results, "case_id").groupBy("mode").agg(F.count("*").alias("findings"), F.countDistinct("case_id").alias("cases"), F.countDistinct(F.when(F.col("outcome") != "completed", F.col("case_id"))).alias("f"), F.countDistinct(F.when(F.col("outcome") == "completed", F.col("case_id"))).alias("c"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return j.crossJoin(F.broadcast(totals)).select("mode", "findings", "cases", share("f", "failed").alias("of_failed"), share("c", "completed").alias("of_completed"))
