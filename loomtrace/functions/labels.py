"""Kinds of files and families of commands, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes and names by kind.
DOCS = (".md", ".rst", ".txt", ".adoc", ".html")
CONFIG = (".json", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".lock", ".env", ".xml", ".properties")
CONFIG_NAMES = ("dockerfile", "makefile", "justfile", ".gitignore", "pyproject.toml", "package.json", "setup.cfg")
CODE = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".c", ".h", ".cc", ".cpp", ".hpp", ".rb", ".php", ".swift", ".scala", ".cs", ".sh", ".sql", ".vue", ".svelte", ".lua", ".ex", ".exs")
TEST_FOLDERS = ("tests", "test", "__tests__", "spec")
#: Command families, strongest first, and the order in which a command is tried on them.
STRONGEST = ("test", "build", "install", "edit", "git", "run", "search", "other")
FAMILIES = {
    "test": r"^(pytest|py\.test|tox|nox|jest|vitest|mocha|rspec|phpunit|ctest|(python3?|uv run( python3?)?) -m (pytest|unittest)|go test|cargo test|(npm|yarn|pnpm|bun)( run)? test|make (test|check))\b",
    "install": r"^((pip3?|uv pip) install|uv (add|sync)|(npm|pnpm) (install|i|ci)\b|yarn (add|install)|poetry (add|install)|brew install|apt(-get)? install|cargo add|go get|gem install)",
    "build": r"^(make|cmake|cargo (build|check|clippy)|go (build|vet)|tsc|mvn|gradle|(npm|yarn|pnpm|bun)( run)? (build|lint|typecheck)|ruff|mypy|pyright|eslint|black|prettier|flake8|pylint|docker build|python3? -m build)\b",
    "edit": r"^(sed -i|sed -E -i|perl -p?i|tee\b|patch\b|apply_patch\b)",
    "git": r"^(git|gh)\b",
    "search": r"^(grep|rg|ag|ack|find|fd|ls|tree|cat|head|tail|sed -n|wc|less|more|file|stat|du|awk|bat|nl|pwd|which|jq)\b",
    "run": r"^(python3?|uv run|node|deno|bun|npx|\./|bash|sh|zsh|ruby|go run|cargo run|(npm|yarn|pnpm) (start|run)|curl|wget|docker|sqlite3)\b",
}
#: What comes before a command without being one, and what parts commands.
SETUP = r"^((cd|export|source|set|ulimit)\b[^&;|]*|[A-Z_][A-Z0-9_]*=\S*\s+|timeout\s+\d+\s+|time\s+|env\s+(\S+=\S+\s+)*)"


PARTED = r"\s*(?:&&|\|\||;|\||\n)\s*"


def file_kind(path: Column) -> Column:
    """test, config, docs, src or other."""
    clean = F.regexp_replace(F.trim(path), r"^['\"]+|['\"]+$", "")
    parts = F.filter(F.split(F.lower(clean), "/"), lambda x: (x != "") & (x != "."))
    name = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    dot = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    test = F.startswith(name, F.lit("test_")) | stem.rlike(r"(_test|\.test|\.spec)$") | F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS)))
    config = name.isin(*CONFIG_NAMES) | dot.isin(*CONFIG) | (F.startswith(name, F.lit(".")) & (dot == ""))
    return F.when(test, "test").when(config, "config").when(dot.isin(*DOCS), "docs").when(dot.isin(*CODE), "src").otherwise("other")


def command_parts(command: Column) -> Column:
    """The commands of a script in order, without set-up prefixes, however many there are."""
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\(+", ""))
    # one set-up prefix after another, with the white space between them
    prefixes = f"^(?:{SETUP.removeprefix('^')}\\s*)+"
    part = lambda x: F.trim(F.regexp_replace(bare(x), prefixes, ""))
    return F.filter(F.transform(F.split(F.trim(command), PARTED), part), lambda x: x != "")


def part_family(part: Column) -> Column:
    out = None
    for name, pattern in FAMILIES.items():
        out = F.when(part.rlike(pattern), name) if out is None else out.when(part.rlike(pattern), name)
    return out.otherwise("other")


def command_family(command: Column) -> Column:
    """The strongest family among a script's commands."""
    ranks = F.transform(command_parts(command), lambda x: F.array_position(F.array(*map(F.lit, STRONGEST)), part_family(x)))
    return F.get(F.array(*map(F.lit, STRONGEST)), (F.coalesce(F.array_min(ranks), F.lit(len(STRONGEST))) - 1).cast("int"))


def significant_part(command: Column) -> Column:
    """The command that decides a script's family."""
    strongest = command_family(command)
    return F.coalesce(F.get(F.filter(command_parts(command), lambda x: part_family(x) == strongest), F.lit(0)), F.trim(command))
