"""Text predicates and functions as columns; Arrow functions only where no built-in says the same."""

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points whose case folding isn't their lower case, by rule.
FOLDS = {chr(c): chr(c).casefold() for c in range(0x80, 0x1FFFF) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()}
#: Syntax that Java reads differently from Python, or not at all.
PYTHON_ONLY = re.compile(r"\(\?P|\(\?\(|\\Z|\\N\{|\(\?[aL]|\\[pPGQEhHXRkz]|&&|\[[^\]]*\[|\{,")


def folded(c: Column, needle: str) -> Column:
    """Case-folded as far as a search for ``needle`` can tell: lower case, and those special foldings that share a
    character with the folded needle."""
    wanted = set(needle.casefold())
    special = {k: v for k, v in FOLDS.items() if wanted & set(v)}
    single = {k: v for k, v in special.items() if len(v) == 1}
    if single:
        c = F.translate(c, "".join(single), "".join(single.values()))
    out = F.lower(c)
    for k, v in special.items():
        if len(v) > 1:
            for x in dict.fromkeys((k, k.lower())):
                if len(x) == 1:
                    out = F.replace(out, F.lit(x), F.lit(v))
    return out


def contains(c: Column, value: str, sensitive: bool = False) -> Column:
    """Two-valued unless case-sensitive: null contains nothing."""
    if sensitive:
        return F.contains(c, F.lit(value))
    return F.coalesce(F.contains(folded(c, value), F.lit(value.casefold())), F.lit(False))


def equals(c: Column, value: str, sensitive: bool = False) -> Column:
    return c == F.lit(value) if sensitive else F.coalesce(folded(c, value) == F.lit(value.casefold()), F.lit(False))


def startswith(c: Column, value: str, sensitive: bool = False) -> Column:
    """A literal prefix after leading white space."""
    c = F.regexp_replace(c, r"^(?U)\s+", "")
    found = F.startswith(c, F.lit(value)) if sensitive else F.startswith(folded(c, value), F.lit(value.casefold()))
    return F.coalesce(found, F.lit(False))


def matches(c: Column, pattern: str, sensitive: bool = False) -> Column:
    """A regular expression found anywhere, Unicode-aware; Python's own engine only for syntax that is Python's."""
    if PYTHON_ONLY.search(pattern):
        flags = 0 if sensitive else re.IGNORECASE

        @F.arrow_udf("boolean")
        def found(v: pa.Array) -> pa.Array:
            compiled = re.compile(pattern, flags)
            return pa.array([x is not None and compiled.search(x) is not None for x in v.to_pylist()], pa.bool_())

        return found(c)
    return F.coalesce(F.rlike(c, F.lit(("(?U)" if sensitive else "(?iuU)") + pattern)), F.lit(False))


def word_tokens(c: Column) -> Column:
    """Lower-cased words (letters and digits) with diacritics removed, in order."""
    flat = F.translate(c, *_plain())
    return F.filter(F.split(F.lower(flat), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _plain() -> tuple[str, str]:
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_words(value: str) -> list[str]:
    """The same for a literal."""
    table = str.maketrans(*_plain())
    return [w for w in re.split(r"[\W_]+", value.translate(table).lower()) if w]


def phrase(c: Column, value: str) -> Column:
    """Whether the words of ``value`` occur next to each other."""
    wanted = plain_words(value)
    if not wanted:
        return F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(word_tokens(c), " "), F.lit(" "))
    return F.coalesce(F.contains(joined, F.lit(f" {' '.join(wanted)} ")), F.lit(False))


def literal_ranges(text: str, value: str, sensitive: bool) -> list[tuple[int, int]]:
    """Where a literal occurs, in code points of the text even where folding changes its length."""
    if not value:
        return []
    if sensitive:
        hay, index = text, None
    else:
        pieces = [ch.casefold() for ch in text]
        hay, value = "".join(pieces), value.casefold()
        index = None if len(hay) == len(text) and all(len(p) == 1 for p in pieces) else [i for i, p in enumerate(pieces) for _ in p]
    out, at = [], hay.find(value)
    while at >= 0:
        end = at + len(value)
        out.append((at, end) if index is None else (index[at], index[end - 1] + 1))
        at = hay.find(value, end)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
