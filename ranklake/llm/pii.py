"""Personal data by a semi-Markov conditional random field (operator 1).

Exact patterns (``base_spans``) give the fixed part of the result. The field adds
spans that patterns miss: numbers that run into their neighbours or lack a country
code, credentials, and addresses written out. A segment has a type and at most
``MAX_TOKENS`` tokens and ``MAX_PARTS`` groups of digits, the bounds of the dynamic
program and the only ones. Its score is
a weighted sum of features of the whole span: separators, digit groups, check digit,
ranges, letter mix, entropy, what stands at its edges and the words before it. The
program finds the best segmentation of the whole text, boundaries and types together,
among candidates that include near misses of every type; what is outside segments
scores zero. Text in base spans is closed to segments, so base spans stay.

Segments that overlap, directly or through others, form a group, and groups are
decoded one by one, which equals the decoding of the whole text.

Weights are trained here by the field's log-likelihood on sentences drawn from a
fixed generator (``training_sentences``) of positives and near misses; the tables have
no span labels.

Defined cases: null and empty texts have no spans; offsets are code points; every
row gives one row, repeated rows too; ``find`` keeps the columns named to it, but for
those named like a result column, which the result replaces; no Spark state is kept
between rows.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import spans as S
from .exchange import tidy

# The kinds in the order of the contract, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the field can add, beside the four base kinds.
TYPES = (*KINDS, "secret")
#: The bounds of a segment: its tokens, and the groups of digits of a number.
MAX_TOKENS, MAX_PARTS = 24, 8
_DIGITS = re.compile(r"[^0-9]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's leftmost matches, tried around each "@" alone: long runs of local characters cost nothing more."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and _LOCAL.match(text, start - 1):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field -------------------------------------------------------------

#: Tokens, by which segments are bounded: runs of letters and digits, or single other characters but white space.
TOKEN = re.compile(r"[^\W_]+|[^\s]")
_AT = re.compile(r"\s?@|\s?[(\[]\s?at\s?[)\]]|\s+at(?=\s)", re.I)
_HOST = re.compile(r"\s?[^\W_](?:[\w-]*[^\W_])?", re.A)
_DOT = re.compile(r"\.(?=[^\W_])|\s?[(\[]\s?dot\s?[)\]]\s?(?=[^\W_])|\s+dot\s+(?=[^\W_])", re.I)
_LOCAL_RUN = re.compile(r"[^\W_](?:[A-Za-z0-9._%+-]*[^\W_])?", re.A)
_NUMBER = re.compile(r"[+(]?[0-9](?:[0-9]|[ .()-](?=[0-9(])|\)(?: |-)(?=[0-9])|\. (?=[0-9]))*")
#: As many tokens without white space, quotes or commas as a segment may have.
_OPAQUE = re.compile(rf"(?:[A-Za-z0-9]++|[!#-&*+\-./:-@\[-`{{-~]){{1,{MAX_TOKENS}}}+")
_PAIR = re.compile(r"[^\s/@:]++:[^\s/@]++(?=@)")
_GROUP = re.compile(r"[+(]?[0-9]+")
_SIGN = re.compile(r"@|[(\[]\s?at\s?[)\]]|\bat(?=\s+[\w-]+(?:\s+dot\s|\.\w))", re.I)
#: Without one of these, in lower case, a text has no address sign, or no credential word, and need not be searched for it.
_SIGN_PARTS, _KEY_PARTS = ("@", "(at", "[at", "( at", "[ at", " dot "), ("pass", "pwd", "token", "secret", "credential", "api", "bearer", "authorization", "login", "://")
_SECRET_WORD = r"(?:pass(?:word|wd|phrase)|pwd|token|secret|credential|api.?key)s?"
_KEYED = re.compile(rf"\b{_SECRET_WORD}\W{{1,4}}(?:is\W{{1,2}})?|\b(?:bearer|authorization|login)\W{{1,3}}|://", re.I)
_LONG = re.compile(r"""[^\s"'=,;()\[\]{}<>]{16,}""")
_CREDENTIAL = re.compile(rf"\b{_SECRET_WORD}\W{{1,4}}(?:is\W{{1,2}})?$", re.I)
_BEARER = re.compile(r"(?:bearer|authorization|login)\W{1,3}$", re.I)
_PREFIXED = re.compile(r"(?:AKIA|ASIA|gh[a-z]_|sk[-_]|pk[-_]|xox[a-z]-|glpat-|AIza|eyJ)[\w-]{8,}", re.A)
_CONTEXT = {
    "email": re.compile(r"(?:e-?mail|contact|write|reach|mailto)\W{0,3}(?:to|at|me|us)?\W{0,3}$", re.I),
    "ip": re.compile(r"(?:ip|host|address|server|from|node|ping)\W{0,3}$", re.I),
    "card": re.compile(r"(?:card|visa|credit|debit|paid with|number)\W{0,3}$", re.I),
    "phone": re.compile(r"(?:tel|phone|call|fax|mobile|cell|ring|dial|text)\W{0,3}(?:me at|at|us|on)?\W{0,3}$", re.I),
    "secret": _CREDENTIAL,
}
_VERSION = re.compile(r"(?:\bv|version|release|section|chapter|figure|fig\.|§)\s?$", re.I)
#: Whole-span features of each type, beside those that all types have.
_COMMON = ("bias", "left", "right", "context", "short", "long")
_OWN = {
    "email": ("sign", "bracket", "word", "dotword", "tld2", "tld3", "tldlong", "tlddigit", "dots", "spaced"),
    "ip": ("range", "over", "zero", "version", "wide"),
    "card": ("luhn", "noluhn", "fours", "plain", "mixed", "len16", "len15", "first"),
    "phone": ("plus", "paren", "n10", "n11to13", "few", "three34", "plain", "date", "dotted", "mixed", "tail4"),
    "secret": ("prefix", "hex", "mixed", "letters", "digits", "len12", "len20", "signs", "dense", "bearer", "pair"),
}
_NAMES = [f"{t}:{f}" for t in TYPES for f in (*_COMMON, *_OWN[t])]
_INDEX = {f: i for i, f in enumerate(_NAMES)}


def _entropy(s: str) -> float:
    n = np.unique(np.frombuffer(s.encode("utf-8", "ignore"), np.uint8), return_counts=True)[1]
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def _shape(s: str, kind: str, text: str, start: int, end: int) -> list[tuple[str, bool]]:
    digits = _DIGITS.sub("", s)
    if kind == "email":
        at = _AT.search(s)
        last = re.split(r"[^A-Za-z0-9-]+", s)[-1]
        dots = re.findall(r"\bdot\b", s[at.end() :], re.I)
        return [
            ("sign", "@" in at[0]), ("bracket", at[0].strip()[0] in "(["), ("word", at[0].strip().lower() == "at"), ("dotword", bool(dots)),
            ("tld2", len(last) == 2), ("tld3", len(last) in (3, 4)), ("tldlong", len(last) > 4), ("tlddigit", any(c.isdigit() for c in last)),
            ("dots", len(dots) + s[at.end() :].count(".") > 1), ("spaced", not dots and bool(re.search(r"\s", s[at.end() :].strip()))),
        ]
    if kind == "ip":
        parts = s.split(".")
        fit = all(len(p) < 4 and int(p) < 256 for p in parts)
        return [("range", fit), ("over", not fit), ("zero", any(len(p) > 1 and p[0] == "0" for p in parts)), ("version", bool(_VERSION.search(text, max(0, start - 10), start))), ("wide", sum(map(len, parts)) > 5)]
    if kind == "card":
        seps = set(_DIGITS.findall(s))
        fours = bool(re.fullmatch(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{2,7}|\d{4}([ -])\d{6}\2\d{5}", s))
        return [("luhn", luhn(digits)), ("noluhn", not luhn(digits)), ("fours", fours), ("plain", not seps), ("mixed", len(seps) > 1), ("len16", len(digits) == 16), ("len15", len(digits) == 15), ("first", s[0] in "3456")]
    if kind == "phone":
        seps = set(x for x in _DIGITS.findall(s) if x not in ("(", ") ", ")", "+", "+("))
        return [
            ("plus", s[0] == "+"), ("paren", "(" in s), ("n10", len(digits) == 10), ("n11to13", 10 < len(digits) < 14), ("few", len(digits) < 10),
            ("three34", bool(re.search(r"(?:^|\D)\d{3}\D{1,2}\d{3}\D\d{4}$", s))), ("plain", s[0] != "+" and s == digits), ("date", bool(re.fullmatch(r"\d{4}[-.]\d\d?[-.]\d\d?.*|\d\d?[-.]\d\d?[-.]\d{4}.*", s))),
            ("dotted", seps == {"."}), ("mixed", len(seps) > 1), ("tail4", bool(re.search(r"\D\d{4}$", s))),
        ]
    letters = any(c.isalpha() for c in s)
    return [
        ("prefix", bool(_PREFIXED.match(s))), ("hex", len(s) > 15 and bool(re.fullmatch(r"[0-9a-f]+", s))), ("mixed", letters and bool(digits)), ("letters", letters and s.isalpha()), ("digits", s.isdigit()),
        ("len12", len(s) > 11), ("len20", len(s) > 19), ("signs", not s.isalnum()), ("dense", _entropy(s) > 3.2), ("bearer", bool(_BEARER.search(text, max(0, start - 20), start))), ("pair", ":" in s and text[end : end + 1] == "@"),
    ]


def span_features(text: str, start: int, end: int, kind: str) -> list[tuple[int, float]]:
    """Features of a whole candidate segment."""
    s = text[start:end]
    edge = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    inner = lambda i, j: 0 <= i < len(text) and text[i] in ".-:" and edge(j)
    found = [
        ("bias", True), ("left", edge(start - 1) or inner(start - 1, start - 2)), ("right", edge(end) or inner(end, end + 1)),
        ("context", bool(_CONTEXT[kind].search(text, max(0, start - 28), start))), ("short", len(s) < 12), ("long", len(s) > 28), *_shape(s, kind, text, start, end),
    ]
    return [(_INDEX[f"{kind}:{name}"], 1.0) for name, on in found if on]


def _ends(text: str, a: int) -> Iterator[tuple[int, str]]:
    """(end, type) of what a segment that starts at a could be, near misses included."""
    c = text[a]
    if c in "+(0123456789" and (a == 0 or not text[a - 1].isdigit()):
        m = _NUMBER.match(text, a, a + 4 * MAX_TOKENS)  # 19 digits and their separators fit
        if m:
            digits = dots = others = parts = 0
            for at in range(a, m.end()):
                x = text[at]
                if x.isdigit():
                    digits += 1
                    if at + 1 < m.end() and text[at + 1].isdigit():
                        continue
                    parts += 1
                    if digits > 19 or parts > MAX_PARTS:
                        return
                    if dots == 3 and not others and digits < 13 and c != "(" and c != "+":
                        yield at + 1, "ip"
                    if 13 <= digits and c.isdigit() and not dots:
                        yield at + 1, "card"
                    if 7 <= digits <= 15:
                        yield at + 1, "phone"
                elif x == ".":
                    dots += 1
                elif at > a:
                    others += 1
    if c.isalnum() and (a == 0 or not _LOCAL.match(text, a - 1)):
        m = _LOCAL_RUN.match(text, a)
        at = m and _AT.match(text, m.end())
        host = at and _HOST.match(text, at.end())
        while host:
            dot = _DOT.match(text, host.end())
            host = dot and _HOST.match(text, dot.end())
            if host:
                yield host.end(), "email"
    if not c.isspace() and c not in "\"'=:,;([{<>" and (a == 0 or not text[a - 1].isalnum()):
        pair = _PAIR.match(text, a) if text.endswith("://", 0, a) else None
        if pair:
            yield pair.end(), "secret"
        keyed = _CREDENTIAL.search(text, max(0, a - 24), a) or _BEARER.search(text, max(0, a - 20), a)
        if keyed or c.isalnum():
            m = _OPAQUE.match(text, a)
            if m and m.end() - a > (5 if keyed else 15):
                end = m.end()
                while end > a and text[end - 1] in ".,;:)]}>":
                    end -= 1
                if end - a > 5 and (keyed or (any(x.isdigit() for x in text[a:end]) and any(x.isalpha() for x in text[a:end]) and not re.search(r"[/@=]", text[a:end]))):
                    yield end, "secret"


def _starts(text: str) -> list[int]:
    """Where a segment may start: groups of numbers, the words before an address sign, credentials and long opaque words."""
    out, low = set(), text.lower()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            out.update(g.start() for g in _GROUP.finditer(text, m.start(), m.end()))
    if any(x in low for x in _SIGN_PARTS):
        for m in _SIGN.finditer(text):
            end = m.start()
            while end and text[end - 1].isspace():
                end -= 1
            a = end
            while a and _LOCAL.match(text, a - 1):
                a -= 1
            while a < end and not text[a].isalnum():
                a += 1
            if a < end:
                out.add(a)
    if any(x in low for x in _KEY_PARTS):
        out.update(m.end() for m in _KEYED.finditer(text))
    out.update(m.start() for m in _LONG.finditer(text))
    return sorted(a for a in out if a < len(text))


def candidates(text: str) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
    """(start, end, type, features) of the segments that could be entities, by start."""
    for a in _starts(text):
        for b, kind in _ends(text, a):
            if b - a <= MAX_TOKENS or sum(1 for _ in TOKEN.finditer(text, a, b)) <= MAX_TOKENS:
                yield a, b, TYPES.index(kind), span_features(text, a, b, kind)


def lattice(segments: list) -> tuple[list[int], list]:
    """The places where segments begin or end, and the segments with places for offsets. What lies between scores zero."""
    places = sorted({x for a, b, _, _ in segments for x in (a, b)})
    number = {x: k for k, x in enumerate(places)}
    return places, [(number[a], number[b], t, f) for a, b, t, f in segments]


def decode(n: int, segments: Iterable, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of n gaps between places: dynamic programming over segments in order of their start."""
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    at = 0

    def ahead(to: int) -> None:
        nonlocal at
        for at in range(at, to):  # a gap outside segments
            if best[at] >= best[at + 1]:
                best[at + 1], back[at + 1] = best[at], None
        at = to

    for i, j, t, f in segments:
        ahead(i)
        score = best[i] + sum(weights[k] * v for k, v in f)
        if score > best[j]:
            best[j], back[j] = score, (i, t)
    ahead(n)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, t = back[j]
            out.append((i, j, t))
            j = i
        else:
            j -= 1
    return out[::-1]


def _expected(n: int, segments: list, weights: np.ndarray) -> np.ndarray:
    """Expected features under the field, by the forward and backward sums."""
    scored = [(i, j, f, sum(weights[k] * v for k, v in f)) for i, j, _, f in segments]
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    ends, begins = {}, {}
    for x in scored:
        ends.setdefault(x[1], []).append(x)
        begins.setdefault(x[0], []).append(x)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1]] + [ahead[i] + s for i, _, _, s in ends.get(j, ())])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1]] + [behind[j] + s for _, j, _, s in begins.get(i, ())])
    out = np.zeros(len(_NAMES))
    for i, j, f, s in scored:
        p = np.exp(ahead[i] + s + behind[j] - ahead[n])
        for k, v in f:
            out[k] += p * v
    return out


def training_sentences(count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with labelled spans, and near misses that are not labelled."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def card(good: bool = True) -> str:
        n = r.choice([14, 14, 14, 13])
        d = r.choice("3456") + number(n)
        d += next(c for c in digit if luhn(d + c) == good)
        if r.random() < 0.5 or n == 13:
            return d
        return r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice([("@", "."), (" (at) ", "."), (" [at] ", " dot "), (" (at) ", " dot "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", ".")])
        local = r.choice([name(), f"{name()}.{name()}", f"{name()}{number(2)}"])
        host = dot.join([name(), *([name()] if r.random() < 0.2 else []), r.choice(["com", "org", "de", "net", "io", "info"])])
        return f"{local}{at}{host}"

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+{r.choice(['1', '44', '49'])} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{number(2)} {number(3)} {number(7)}", f"+{number(12)}", f"{a} {b} {c}"])

    def secret() -> tuple[str, str]:
        key = lambda: r.choice(["AKIA" + some(upper + digit, 16), "sk-" + some(lower + upper + digit, 32), "ghp_" + some(lower + upper + digit, 36), "xoxb-" + some(digit, 11) + "-" + some(lower + digit, 24)])
        word = lambda: r.choice([some(lower + digit, r.randint(8, 14)), name() + number(2) + r.choice("!?#") + name(), some("0123456789abcdef", r.choice([16, 18, 32, 40])), name() + name() + r.choice("!#$") + number(1)])
        how = r.random()
        if how < 0.4:
            return "", key()
        if how < 0.85:
            return r.choice(["password=", 'token = "', "secret: ", "api_key: ", "passwd is ", "pwd: "]), word()
        return "ftp://", f"{name()}:{name()}{number(2)}"

    makers = {"email": lambda: ("", email()), "ip": lambda: (r.choice(["", "", "host ", "from "]), ".".join(str(r.randint(1, 255)) for _ in range(4))), "card": lambda: (r.choice(["", "", "card ", "visa: "]), card()), "phone": lambda: (r.choice(["", "", "tel ", "call ", "phone: "]), phone()), "secret": secret}
    others = [
        lambda: number(r.randint(1, 9)), lambda: f"{number(3)}.{number(1)}", lambda: card(False), lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"version {number(1)}.{number(1)}.{number(1)}.{number(2)}", lambda: some("0123456789abcdef", 32),
        lambda: f"+{number(2)}", lambda: f"{name()} at {name()}", lambda: f"{name()} at {name()} {name()}", lambda: f"{r.randint(300, 999)}.{number(3)}.{number(2)}.{number(2)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}", lambda: " ".join(number(r.randint(1, 4)) for _ in range(r.randint(2, 7))), lambda: number(r.randint(10, 13)), lambda: f"{name()}@{name()}", lambda: f"{name()} (at) {name()}",
        lambda: f"password {name()}", lambda: f"token {name()}", lambda: f"{name()}_{name()}_{number(2)}", lambda: f"{name()}-{name()}-{number(4)}", lambda: f"{number(4)}-{number(4)}", lambda: f"{number(2)}-{number(2)}-{number(3)}", lambda: f"secret {name()} {name()}", lambda: f"{number(1)},{number(3)},{number(3)}.{number(2)}",
    ]
    out = []
    for _ in range(count):
        text, spans = name(), []
        for _ in range(r.randint(1, 5)):
            text += r.choice([" ", " ", " ", ", ", "; "])
            if r.random() < 0.5:
                kind = r.choice(TYPES)
                before, s = makers[kind]()
                text += before
                spans.append((len(text), len(text) + len(s), kind))
                text += s + ("@host" if before == "ftp://" else "")
            else:
                text += r.choice(others)()
            if r.random() < 0.6:
                text += " " + name()
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def trained(count: int = 700, rounds: int = 100, l2: float = 0.01) -> tuple[float, ...]:
    """Weights by gradient ascent on the field's log-likelihood."""
    data = []
    for text, spans in training_sentences(count):
        segments = list(candidates(text))
        truth = np.zeros(len(_NAMES))
        for a, b, t, f in segments:
            if (a, b, TYPES[t]) in spans:
                for k, v in f:
                    truth[k] += v
        if segments:
            places, segments = lattice(segments)
            data.append((len(places) - 1, segments, truth))
    w = np.zeros(len(_NAMES))
    scale = np.full(len(w), 1e-6)
    for _ in range(rounds):
        g = sum((truth - _expected(n, segments, w)) for n, segments, truth in data) - l2 * len(data) * w
        scale += g * g
        w += 2.0 * g / np.sqrt(scale)
    return tuple(w)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the field's segments outside base spans.

    Tokens without a candidate over them score zero, so each group of overlapping candidates is decoded by itself,
    which is the decoding of the whole text.
    """
    closed = sorted((a, b) for a, _, b in base)
    begins = [a for a, _ in closed]
    out: list[tuple[int, int, str]] = []
    group: list[tuple[int, int, int, list]] = []
    reach = 0

    def settle() -> None:
        places, segments = lattice(group)
        out.extend((places[i], places[j], TYPES[t]) for i, j, t in decode(len(places) - 1, segments, weights))

    for a, b, t, f in candidates(text):
        k = bisect_left(begins, b)
        if k and max(e for _, e in closed[max(0, k - len(KINDS)) : k]) > a:
            continue
        if group and a >= reach:
            settle()
            group, reach = [], 0
        group.append((a, b, t, f))
        reach = max(reach, b)
    if group:
        settle()
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """The base spans, and all spans in order of start."""
    base = base_spans(text)
    more = added_spans(text, base, weights)
    order = {k: i for i, k in enumerate(TYPES)}
    return base, sorted([(a, b, KINDS[k]) for a, k, b in base] + more, key=lambda x: (x[0], order[x[2]], x[1]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its type in brackets; overlapping spans go as one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULTS = ("base", "spans", "redacted")
SLICE = 1 << 20


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with base (array of start, end, kind), spans (the same, all) and redacted text."""
    weights = np.array(trained())
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in RESULTS]
    text = "_" + max([c.lower() for c in kept], key=len, default="") + "_"
    span = StructType().add("start", "integer").add("end", "integer").add("kind", "string")
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias(text))
    schema = StructType([*own.schema[:-1]]).add("base", ArrayType(span)).add("spans", ArrayType(span)).add("redacted", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for b in S.slices(batch, text, SLICE):
                base, spans, clean = [], [], []
                for x in b.column(text).to_pylist():
                    x = x or ""
                    first, every = all_spans(x, weights)
                    base.append([{"start": a, "end": e, "kind": KINDS[k]} for a, k, e in first])
                    spans.append([{"start": a, "end": e, "kind": k} for a, e, k in every])
                    clean.append(redacted(x, every) if every else x)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, kind), pa.array(spans, kind), pa.array(clean, pa.string())], names=[*kept, *RESULTS])

    return own.mapInArrow(tidy(scan), schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with a type in brackets for each span of personal data in text, all other columns as they are; null texts stay."""
    weights = np.array(trained())
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in S.slices(batch, "text", SLICE):
                clean = [x and redacted(x, all_spans(x, weights)[1]) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(clean, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(tidy(scan), docs.schema)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def query(spark, sf_dir: str) -> DataFrame:
    """op1: counts, digest and spans of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
