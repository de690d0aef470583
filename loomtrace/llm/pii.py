"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans of four kinds.  Around every trigger (a digit, an at sign, a plus, a spelt-out "at", a
vendor's key prefix, or a word that announces personal data before a colon or an equals sign) the field then reads a
short region of tokens.  Every run of up to LONGEST tokens that begins and ends like a value is a candidate segment;
features of the whole segment score it for every type, and dynamic programming over positions and types jointly
chooses boundaries and types.  Everywhere else the only label is "other", whose score is 0.  A long key or number is one
token, whatever its length, so that segments aren't cut short.  The weights are fitted on the driver by maximising the
conditional likelihood of sentences that a seeded generator writes.

All patterns take time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_text_struct

#: Fixed patterns of the base kinds, in the order in which kinds are listed.  A match can only begin where its first run
#: of characters does, so that runs which match nothing are read once: the part of an address after its @, the part
#: before it (read backwards), and numbers from their first digit on.
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn")
OTHER = "other"
#: Tokens of a segment at most, and characters read on either side of a trigger.
LONGEST, AROUND = 16, 64

TOKENS = re.compile(r"eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+|[A-Za-z0-9+/_-]{20,}|[^\W_]+|[^\w\s]|_")
CUES = {"phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "tél", "teléfono"}, "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"}, "ip": {"ip", "host", "server", "address"}, "email": {"email", "mail", "contact", "write"}, "secret": {"token", "secret", "password", "passwd", "key", "apikey", "api", "pwd", "bearer", "credential"}, "iban": {"iban", "account", "konto", "compte", "cuenta"}, "ssn": {"ssn", "social", "security"}}
VENDORS = ("AKIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "eyJ")
#: Triggers: characters, "at" in brackets, and a cue before what assigns a value.
TRIGGER = re.compile(r"[0-9@+]")
SPELT_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
SPELT_DOT = re.compile(r" ?[\[(] ?dot", re.I)
ASSIGNS = re.compile(r"[:=]")
ANNOUNCED = re.compile(r"(?:^|[^A-Za-z])(?:" + "|".join(sorted({w for words_ in CUES.values() for w in words_})) + r")[\"']?\s{0,3}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind; a match that fails its test is dropped
    and not retried."""
    out, at = [], 0
    while (k := text.find("@", at)) >= 0:
        if (m := EMAIL_REST.match(text, k)) is None:
            at = k + 1
            continue
        start = k
        while start > at and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < k:
            out.append(("email", start, m.end()))
        at = m.end() if start < k else k + 1
    if (first := re.search("[0-9]", text)) is None:
        return out
    at = first.start()
    if text.find(".", at) >= 0:
        out += [("ip", *m.span()) for m in IP.finditer(text, at) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text, at) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --------------------------------------------------------------------------- features
_SHAPES = [("phone-local", re.compile(r"0\d{2,5}(?:[ /-]\d{2,9}){1,4}")), ("phone-us", re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")), ("phone-country", re.compile(r"(?:\+|00)\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ .-]?){2,5}")), ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}")), ("quad", re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")), ("email", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", re.A)), ("email-spelt", re.compile(r"[\w.]+ ?[\[(] ?at ?[\])] ?[\w-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]+)+", re.I | re.A)), ("iban", re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")), ("card-groups", re.compile(r"\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}")), ("number", re.compile(r"\d+(?:[.,]\d+)*")), ("date", re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}")), ("hex-long", re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")), ("mixed-long", re.compile(r"(?=[A-Za-z_-]*\d)(?=[\d_-]*[A-Za-z])[A-Za-z0-9_-]{20,}")), ("vendor-key", re.compile(r"(?:AKIA|ghp_|gho_|sk-|xox[bp]-|eyJ)[A-Za-z0-9_.-]{16,}"))]


def span_features(text: str, start: int, end: int, before: frozenset[str]) -> list[str]:
    """Features of a whole segment: its shape, its digits, checks on its value, and words that announce it."""
    s = text[start:end]
    d = _digits(s)
    value = bool(d) or "@" in s or "[" in s or "(" in s or len(s) >= 16
    out = [f"shape:{n}" for n, p in _SHAPES if p.fullmatch(s)] if value else []
    out.append(f"digits:{min(len(d), 20) // 2}")
    if 12 <= len(d) <= 19 and len(d) >= len(s) - 4:
        out.append(f"luhn:{luhn(d)}")
    if "shape:quad" in out:
        out.append(f"octets:{all(int(x) <= 255 for x in s.split('.'))}")
    if "shape:iban" in out:
        raw = s.replace(" ", "")
        out.append(f"mod97:{int(''.join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1}")
    if "shape:ssn" in out:
        out.append(f"area:{s[:3] not in ('000', '666') and s[0] != '9'}")
    joined = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    out.append(f"edge:{bool(joined)}")
    if start and text[start - 1] in "+-./$€£#=" and text[start - 1 : start] != "=":
        out.append("glued-left")
    if end + 1 < len(text) and text[end] in ".,-/:" and text[end + 1].isalnum():
        out.append("glued-right")
    if SPELT_DOT.match(text, end):
        out.append("dot-right")
    shape = out[0] if out[0].startswith("shape:") else "shape:none"
    lead = text[max(0, start - 4) : start].rstrip(" \t\"'")
    given = "given" if lead.endswith(("=", ":")) else "free"
    closed_ = given == "given" and (end == len(text) or text[end] in " \t\n\"',;") and not any(c.isspace() for c in s)
    out += [shape, f"size:{min(len(s), 32) // 4}&{shape}", f"{'closed' if closed_ else 'open'}&{shape}"]
    out += [f"cue:{k}" for k in before] + [f"cue:{k}&{shape}&{given}" for k in before]
    if not before:
        out.append(f"no-cue&{shape}")
    return out


class Region:
    """Tokens around triggers, and the segments that may be values, each with its features."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        words_ = [text[a:b].lower() for a, b in tokens]
        kinds = [[k for k, cues in CUES.items() if w in cues] for w in words_]
        self.segments: list[tuple[int, int, tuple[str, ...]]] = []
        for i, (a, _) in enumerate(tokens):
            if not (text[a].isalnum() or text[a] in "+(_-/"):
                continue
            before = frozenset(k for some in kinds[max(0, i - 6) : i] for k in some)
            for j in range(i, min(len(tokens), i + LONGEST)):
                if j > i and (tokens[j][0] - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1] : tokens[j][0]]):
                    break
                b = tokens[j][1]
                if text[b - 1].isalnum() or text[b - 1] in ")_-/":
                    self.segments.append((i, j + 1, tuple(span_features(text, a, b, before))))


class SemiMarkovField:
    """Weights of each feature for each kind; a segment's score for a kind is the sum over its features."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))
        self.memo: dict[tuple[str, ...], list[tuple[str, float]]] = {}

    def ids(self, features: tuple[str, ...]) -> list[int]:
        return [i for f in ("bias", *features) if (i := self.index.get(f)) is not None]

    def worth(self, features: tuple[str, ...]) -> list[tuple[str, float]]:
        """The kinds for which such a segment scores above "other"."""
        if (found := self.memo.get(features)) is None:
            found = [(k, float(x)) for k, x in zip(KINDS, self.w[self.ids(features)].sum(axis=0), strict=True) if x > 0]
            if len(self.memo) < 1 << 16:
                self.memo[features] = found
        return found

    def decode(self, region: Region) -> list[tuple[str, int, int]]:
        """The best segmentation: dynamic programming over token positions; "other" tokens score 0."""
        n = len(region.tokens)
        ending: list[list] = [[] for _ in range(n + 1)]
        for i, j, features in region.segments:
            ending[j] += ((i, kind, s) for kind, s in self.worth(features))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, s in ending[j]:
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, region.tokens[i][0], region.tokens[j - 1][1]))
                j = i
        return out[::-1]

    @staticmethod
    def marginals(n: int, start: np.ndarray, end: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """The probability of each segment and kind, by forward and backward sums, and the log of the total."""
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        by_end, by_start = [np.flatnonzero(end == j) for j in range(n + 1)], [np.flatnonzero(start == j) for j in range(n + 1)]
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce(np.append(alpha[start[by_end[j]]] + whole[by_end[j]], alpha[j - 1]))
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce(np.append(beta[end[by_start[i]]] + whole[by_start[i]], beta[i + 1]))
        return np.exp(np.minimum(0.0, (alpha[start] + beta[end] - alpha[n])[:, None] + scores)), float(alpha[n])

    def prepare(self, data: list[tuple[Region, dict[tuple[int, int], str]]]) -> list[tuple]:
        """Numbers for each region: tokens, starts, ends, feature ids (padded) and the true kinds."""
        for r, _ in data:
            for *_, f in r.segments:
                for x in ("bias", *f):
                    self.index.setdefault(x, len(self.index))
        out = []
        for r, gold in data:
            ids = [self.ids(f) for *_, f in r.segments]
            wide = max(map(len, ids), default=0)
            table = np.array([[*x, *[len(self.index)] * (wide - len(x))] for x in ids], np.int64).reshape(len(ids), wide)
            true = np.zeros((len(ids), len(KINDS)))
            for k, (i, j, _) in enumerate(r.segments):
                if (i, j) in gold:
                    true[k, KINDS.index(gold[i, j])] = 1
            out.append((len(r.tokens), np.array([x[0] for x in r.segments], np.int64), np.array([x[1] for x in r.segments], np.int64), table, true))
        self.w = np.zeros((len(self.index) + 1, len(KINDS)))  # the last row, of nothing, stays 0
        return out

    def gradient(self, n: int, start: np.ndarray, end: np.ndarray, ids: np.ndarray, true: np.ndarray) -> np.ndarray:
        """Of one region's conditional log-likelihood: what was seen minus what is expected."""
        p, _ = self.marginals(n, start, end, self.w[ids].sum(axis=1))
        out = np.zeros_like(self.w)
        np.add.at(out, ids, np.broadcast_to((true - p)[:, None, :], (*ids.shape, len(KINDS))))
        out[-1] = 0
        return out

    def fit(self, data: list[tuple[Region, dict[tuple[int, int], str]]], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-4) -> None:
        """Stochastic gradient (AdaGrad) on the conditional log-likelihood."""
        made = self.prepare(data)
        power = np.full_like(self.w, 1e-8)
        for _ in range(epochs):
            for n, start, end, ids, true in made:
                if not len(ids):
                    continue
                g = self.gradient(n, start, end, ids, true)
                g -= ridge * self.w * (g != 0)
                power += g * g
                self.w += rate * g / np.sqrt(power)
        self.memo = {}


# --------------------------------------------------------------------------- training sentences
def _sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with marked spans; half of what looks alike isn't personal data and stays unmarked."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstuw") for _ in range(r.randint(2, 9)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def check_digit(body: str) -> str:
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB"]), number(18)
        return f"{country}{98 - int(body + ''.join(str(int(c, 36)) for c in country) + '00') % 97:02d}{body}"

    def grouped(x: str) -> str:
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def secret(least: int, letters: str) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(least, least + 12)))

    def card() -> str:
        c = check_digit(r.choice("3456") + number(r.choice([13, 14, 14, 14])))
        return c if r.random() < 0.5 or len(c) != 16 else r.choice(" -").join(c[i : i + 4] for i in range(0, 16, 4))

    def not_card() -> str:
        c = number(16)
        return not_card() if luhn(c) or c[0] == "0" else c

    def made() -> tuple[str, str | None, list[str]]:
        octet = lambda: str(r.randint(1, 255))
        local = f"({number(3)}) {number(3)}-{number(4)}" if r.random() < 0.5 else r.choice("-. ").join((number(3), number(3), number(4)))
        return r.choice([
            lambda: (f"{word()}{r.choice('._')}{word()}@{word()}.{r.choice(['com', 'org', 'de'])}", "email", ["email", "mail", "contact"]),
            lambda: (f"{word()} [at] {word()} [dot] com", "email", ["email", "contact"]),
            lambda: (f"{word()} (at) {word()}.com", "email", ["email", "contact"]),
            lambda: (".".join(octet() for _ in range(4)), "ip", ["ip", "host"]),
            lambda: (".".join(str(r.randint(256, 999)) for _ in range(4)), None, []),
            lambda: (card(), "card", ["card", "visa"]),
            lambda: (not_card(), None, []),
            lambda: (r.choice(["00", "000"]) + number(r.randint(9, 14)), None, []),
            lambda: (f"+{r.randint(1, 99)} {local}", "phone", ["phone", "call", "tel"]),
            lambda: (local, "phone", ["phone", "call", "tel"]),
            lambda: (f"{r.randint(100, 899)}-{r.randint(10, 99)}-{number(4)}", "ssn", ["ssn"]),
            lambda: (f"9{number(2)}-{number(2)}-{number(4)}", None, []),
            lambda: (iban(), "iban", ["iban", "account"]),
            lambda: (grouped(iban()), "iban", ["iban", "account"]),
            lambda: (f"0{number(r.randint(2, 4))}{r.choice(' /-')}{number(r.randint(6, 8))}", "phone", ["phone", "call", "tel", "mobile"]),
            lambda: (f"0{number(r.randint(2, 4))}{r.choice(' /-')}{number(r.randint(6, 8))}", None, []),
            lambda: (f"{word()}{r.choice('._')}{word()}{r.choice([' [at] ', '[at]', ' (at) '])}{word()}{r.choice([' [dot] ', '[dot]', '.'])}{word()}{r.choice([' [dot] ', '.'])}com", "email", ["email", "mail", "contact"]),
            lambda: (secret(7, "abcdefghijkmnpqrstuvwxyz"), "assigned", ["password", "passwd", "secret", "token", "pwd"]),
            lambda: (secret(7, "abcdefghjkmnpqrstuvwxyz23456789"), "assigned", ["password", "api", "key", "secret", "token"]),
            lambda: (word(), "plain", ["key", "token", "account", "address", "contact", "host", "card", "phone"]),
            lambda: ("".join(r.choice("0123456789abcdef") for _ in range(40)), "secret", ["token", "secret", "key", "password"]),
            lambda: (r.choice(["AKIA", "ghp_", "sk-"]) + "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(20)), "secret", ["key"]),
            lambda: ("".join(r.choice("0123456789abcdef") for _ in range(40)), None, []),
            lambda: (number(r.randint(1, 11)), None, []),
            lambda: (f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", None, []),
            lambda: (f"{r.randint(1, 30)}.{r.randint(0, 30)}.{r.randint(0, 99)}", None, []),
            lambda: (f"{r.randint(1, 999)},{number(3)}.{number(2)}", None, []),
        ])()

    text, marks = "", []
    for _ in range(r.randint(1, 2)):
        text += " ".join(word() for _ in range(r.randint(1, 5))) + " "
        value, kind, cues = made()
        vendor = value.startswith(("AKIA", "ghp_", "sk-"))
        must = (kind == "secret" and not vendor) or kind == "ssn" or (kind == "phone" and value[0] == "0")
        if kind == "assigned":
            # words count as secrets only where a cue assigns them
            kind = "secret" if r.random() < 0.7 else None
            text += r.choice(cues) + (r.choice([": ", " = ", ' = "', "=", ": "]) if kind else r.choice([" ", " is ", " and ", " of "]))
        elif kind == "plain":
            kind = None
            text += r.choice(cues) + r.choice([" ", " is ", ": ", " = "])
        elif cues and (must or r.random() < 0.4):
            text += r.choice(cues) + r.choice([" ", ": ", " = ", ' = "', " is "])
        marks += [(kind, len(text), len(text) + len(value))] if kind else []
        text += value + r.choice([" ", ". ", ", ", '" '])
    return text + word(), marks


def triggers(text: str) -> list[tuple[int, int]]:
    """Where a region is worth reading, in order."""
    out = [m.span() for m in TRIGGER.finditer(text)]
    if "[" in text or "(" in text:
        out += [m.span() for m in SPELT_AT.finditer(text)]
    for v in VENDORS:
        at = text.find(v)
        while at >= 0:
            out.append((at, at + len(v)))
            at = text.find(v, at + 1)
    if ":" in text or "=" in text:
        out += [m.span() for m in ASSIGNS.finditer(text) if ANNOUNCED.search(text, max(0, m.start() - 24), m.start())]
    return sorted(out)


def regions(text: str) -> list[Region]:
    """Regions of tokens around the triggers of a text; neighbouring ones are one."""
    spans: list[list[int]] = []
    for first, last in triggers(text):
        a, b = max(0, first - AROUND), last + AROUND
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, done = [], 0
    for a, b in spans:
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b - 1].isspace():
            b += 1
        a, b = max(a, done), min(b, len(text))
        if tokens := [m.span() for m in TOKENS.finditer(text, a, b)]:
            out.append(Region(text, tokens))
        done = max(done, b)
    return out


@lru_cache
def fitted(sentences: int = 900, seed: int = 5) -> SemiMarkovField:
    """The field, fitted on ``sentences`` generated ones."""
    r, data = random.Random(seed), []
    for _ in range(sentences):
        text, marks = _sentence(r)
        for region in regions(text):
            starts, ends = {a: i for i, (a, _) in enumerate(region.tokens)}, {b: i + 1 for i, (_, b) in enumerate(region.tokens)}
            gold = {(starts[a], ends[b]): kind for kind, a, b in marks if a in starts and b in ends}
            data.append((region, gold))
    field = SemiMarkovField()
    field.fit(data)
    return field


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by start and then kind as listed.  A span of the field that overlaps a base span gives way."""
    order = lambda x: (x[1], KINDS.index(x[0]))
    read = regions(text)
    if not read:
        return [], []
    base = sorted(base_spans(text), key=order)
    # base spans may overlap or lie within one another: what they cover together, in order
    starts, ends = [], []
    for _, a, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found = []
    for region in read:
        for kind, a, b in field.decode(region):
            k = bisect_left(starts, b) - 1
            if k < 0 or ends[k] <= a:
                found.append((kind, a, b))
    return base, sorted([*base, *found], key=order)


PII = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string"


def _detect(texts: pa.Array, field: SemiMarkovField) -> dict:
    counts: dict[str, list[int]] = {k: [] for k in BASE}
    digests, all_spans, redacted = [], [], []
    empty = hashlib.sha256(b"").hexdigest()
    for value in texts:
        text = value.as_py() or ""
        base, spans = find_spans(text, field)
        for k in BASE:
            counts[k].append(sum(x[0] == k for x in base))
        digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() if base else empty)
        all_spans.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        redacted.append(redact(text, spans) if spans else None)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return {**{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": pa.array(digests), "spans": pa.array(all_spans, kind), "redacted": pa.array(redacted, pa.string())}


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in capitals and brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with one struct column added, and its name: counts and digest of the base spans, ``spans`` (all,
    with code-point offsets, end exclusive) and ``redacted`` (null where nothing was found).

    Null and empty texts have no spans.  Rows are kept, repeated ones too; other columns pass through whatever their
    names.
    """
    name = free_name(docs, "pii")
    shared = docs.sparkSession.sparkContext.broadcast(fitted())
    return with_text_struct(docs, text, name, PII, lambda: lambda texts: _detect(texts, shared.value)), name


def spans_text(column):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
