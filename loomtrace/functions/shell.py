"""Shell commands inside tool calls."""

import json
import re
import shlex

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SHELLS = {"bash", "sh", "zsh", "/bin/bash", "/bin/sh", "/bin/zsh", "/usr/bin/bash"}
#: ``exec_command({cmd: "..."})`` and the like inside a script: only literal strings are read.
WRAPPED = re.compile(r"\b([A-Za-z_][\w.]*)\s*\(\s*\{(.*?)\}\s*\)", re.S)
LITERAL = re.compile(r"""["']?(cmd|command|workdir|cwd)["']?\s*:\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\$])*`)""", re.S)


def script(value) -> str | None:
    """The script that a command argument submits: text as it is, an argument vector without its shell wrapper."""
    if isinstance(value, str):
        try:
            argv = shlex.split(value)
        except ValueError:
            return value
        if len(argv) == 3 and argv[0] in SHELLS and argv[1] in ("-c", "-lc"):
            return argv[2]
        return value
    if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
        return value[2] if len(value) == 3 and value[0] in SHELLS and value[1] in ("-c", "-lc") else shlex.join(value)
    return None


def _plain(literal: str) -> str | None:
    try:
        return json.loads('"' + literal[1:-1].replace('\\"', '"').replace('"', '\\"').replace("\\'", "'").replace("\n", "\\n") + '"')
    except ValueError:
        return None


def of_call(tool: str | None, action: str | None, arguments: str | None) -> list[dict]:
    """The commands of a tool call, numbered; ``wrapped`` ones stand in a script."""
    if not arguments:
        return []
    try:
        args = json.loads(arguments)
    except ValueError:
        args = arguments
    name = re.split(r"__|\.", tool or "")[-1]
    if isinstance(args, dict) and (action == "shell.exec" or name in ("bash", "shell", "Bash", "exec_command", "run_command")):
        for k in ("command", "cmd", "CommandLine", "script"):
            if (found := script(args.get(k))) is not None:
                return [{"command": found, "index": 0, "wrapped": False}]
    code = args.get("code") or args.get("input") if isinstance(args, dict) else args if isinstance(args, str) else None
    out = []
    if isinstance(code, str):
        for call in WRAPPED.finditer(code):
            values = {k: _plain(v) for k, v in LITERAL.findall(call[2])}
            if (found := values.get("cmd") or values.get("command")) is not None:
                out.append({"command": script(found), "index": len(out), "wrapped": True})
    return out


def commands(tool: Column, action: Column, arguments: Column) -> Column:
    kind = pa.list_(pa.struct([("command", pa.string()), ("index", pa.int32()), ("wrapped", pa.bool_())]))

    @F.arrow_udf("array<struct<command:string,index:int,wrapped:boolean>>")
    def found(t: pa.Array, a: pa.Array, r: pa.Array) -> pa.Array:
        return pa.array([of_call(*x) for x in zip(t.to_pylist(), a.to_pylist(), r.to_pylist(), strict=True)], kind)

    return found(tool, action, arguments)
