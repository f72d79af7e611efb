"""Personal data: candidate spans from generators, judged by gradient-boosted trees.

The base patterns (e-mail, IPv4 address, payment card, phone) are redacted always. High-recall generators propose
further spans, which may overlap one another and the base's: runs of digits, in groups or unbroken, addresses with
spelt-out signs, numbers after words that announce them, account numbers that begin with a country, and long strings of
letters and digits (keys, tokens, passwords). Trees boosted on format and context features score each; a threshold
calibrated on held-out candidates of the sample selects those that are added, best first, where they touch no other.

There are no labels for such spans, so the trees learn from base spans made over, in their own context, into what base
patterns do not match; how each is made over is its label. On a bounded sample of documents, a candidate that is exactly
a span without its '+', '@' or separators, a number after a cue word, an account number with the right check digits or a
random string that is announced as a secret or begins like one is positive; one that is only part of it, or of a date,
amount, running number, digest or joined words put in its place, is negative. Candidates that documents hold themselves
have no label and are left out.

Scale: fitted on the sample (about ``SCAN_DOCS`` documents, those with the smallest hashes of ids; at most
``SAMPLE_SPANS`` candidates go to the driver); then one narrow stage reads every whole text. Work is linear in a text's length up to a logarithm, and memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import hash_share, parts, table, trimmed

KINDS = ("email", "ip", "card", "phone", "other")
BASE = KINDS[:4]
SCAN_DOCS, SAMPLE_SPANS = 20_000, 32_000
ROUNDS, LEAVES_DEPTH, RATE, L2, BINS = 80, 4, 0.2, 2.0, 64
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[0-9]")
# Generators of further candidates; each is linear.
_GROUPS = re.compile(r"\(?[0-9][\x20().0-9/-]*[0-9]")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]? ?(?:at|AT)(?: ?[\])])? ?[A-Za-z0-9-]{1,64}+(?: ?[\[(]? ?(?:dot|DOT)(?: ?[\])])? ?[A-Za-z]{2,24}+)+")
_CUE = re.compile(r"(?i)(?<![a-z])(?:(?:tele)?phone|tel|call|mobile|cell|fax|card|account|acct|iban|ssn|passport|e?-?mail|contact|ip|address|id)(?:e?s)?(?![a-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_SECRET_CUE = re.compile(r"(?i)(?<![a-z])(?:api[_ -]?key|access[_ -]?key|key|tokens?|secret|passwords?|passwd|pwd|bearer|credentials?|auth)(?![a-z])[^A-Za-z0-9]{0,6}$")
_SECRET_START = re.compile(r"AKIA[0-9A-Z]|gh[pousr]_|sk[-_]|eyJ|xox[abp]-|AIza|glpat-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CUE_REACH, WINDOW = 24, 5
TLDS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au ch at be pl se no".split())
_DIGIT = re.compile("[0-9]")
_SWITCH = re.compile("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind, then start. Each equals its regular expression's leftmost matches."""
    out: list[Span] = []
    at, p = 0, text.find("@")
    while p >= 0:
        start = p
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, p + 1) if start < p else None
        if m:
            out.append(("email", start, m.end()))
            at = m.end()
        p = text.find("@", max(p + 1, at))
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                parts, begin = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = begin + sum(map(len, four)) + 3
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                        out.append(("ip", begin, end))
                    begin = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if m.end() - m.start() > 2 and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def iban_holds(s: str) -> bool:
    """Whether letters and digits, the first four moved to the end, are 1 modulo 97."""
    s = s.replace(" ", "")
    return len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Numbers inside a run: up to ``WINDOW`` groups in a row, at most two characters apart, of 7 to 19 digits."""
    groups = [m.span() for m in re.compile("[0-9]+").finditer(text, start, end)]
    for i, (a, _) in enumerate(groups):
        a -= a > start and text[a - 1] == "("
        digits = 0
        for j in range(i, min(i + WINDOW, len(groups))):
            if j > i and groups[j][0] - groups[j - 1][1] > 2:
                break
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 7:
                yield a, groups[j][1]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be personal data, base ones not among them; they may overlap."""
    out = set()
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= 7:
                out.add(m.span())
                out.update(_windows(text, *m.span()))
        for cue in _CUE.finditer(text):
            at = _DIGIT.search(text, cue.end(), cue.end() + CUE_REACH)
            m = _GROUPS.match(text, at.start() - (text[at.start() - 1] == "(")) if at else None
            if m:
                out.add(m.span())
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m[0]) and not m[0].isdigit():
                out.add(m.span())
        out.update(m.span() for m in _IBAN.finditer(text))
    low = text if ("dot" in text or "DOT" in text) else ""
    if low:
        out.update(m.span() for m in _SPELT.finditer(text))
    return sorted(out)


NAMES = ("chars", "digits", "groups", "longest_group", "dots", "dashes", "spaces", "parentheses", "letters", "plus_before", "luhn", "cue_before", "letter_touches", "at_sign", "first_digit", "slashes", "first_group", "last_group", "digit_touches", "tld", "switches", "upper", "secret_cue", "secret_start", "iban", "hexadecimal", "distinct", "vowels")


def features(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall("[0-9]+", s)
    before = text[max(0, start - CUE_REACH - 8) : start]
    announced = re.split("[0-9]", before)[-1]  # no other number between the cue and the span
    last = re.search("[A-Za-z]*$", s)[0].lower()
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    vowels = sum(map(s.count, "aeiouAEIOU"))
    secret = [len(_SWITCH.findall(s)), sum(c.isupper() for c in s), _SECRET_CUE.search(before) is not None, _SECRET_START.match(s) is not None, _IBAN.fullmatch(s) is not None and iban_holds(s), not s.lower().strip("0123456789abcdef"), len(set(s)), vowels / len(s)]
    return [len(s), len(digits), len(groups), max(map(len, groups), default=0), s.count("."), s.count("-"), s.count(" "), s.count("(") + s.count(")"), sum(c.isalpha() for c in s), before[-1:] == "+", 13 <= len(digits) <= 19 and luhn(digits), _CUE.search(announced) is not None, any(c.isalpha() for c in near), "@" in s, int(digits[0]) if digits else -1, s.count("/"), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, any(c.isdigit() for c in text[max(0, start - 3) : start] + text[end : end + 3]), last in TLDS, *secret]


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    below: Tree | None = None
    above: Tree | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        out, low = np.empty(len(x)), x[:, self.feature] < self.cut
        out[low], out[~low] = self.below.predict(x[low]), self.above.predict(x[~low])
        return out


def cuts_of(v: np.ndarray) -> np.ndarray:
    """Places to cut a feature: halfway between its values, at most ``BINS`` of them by quantiles."""
    values = np.unique(v)
    if len(values) > BINS:
        values = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """``codes``: for each feature, how many of its cuts a value has reached."""
    leaf = Tree(value=float(g.sum() / (h.sum() + L2)))
    if not depth or len(codes) < 10:
        return leaf
    best, at = 1e-6, None
    for j, c in enumerate(cuts):
        if len(c):
            gl, hl = (np.cumsum(np.bincount(codes[:, j], w, len(c) + 1)) for w in (g, h))
            gain = gl[:-1] ** 2 / (hl[:-1] + L2) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + L2) - gl[-1] ** 2 / (hl[-1] + L2)
            i = int(gain.argmax())
            if gain[i] > best:
                best, at = float(gain[i]), (j, i)
    if at is None:
        return leaf
    j, i = at
    low = codes[:, j] <= i
    if low.all() or not low.any():
        return leaf
    return Tree(j, float(cuts[j][i]), grow(codes[low], cuts, g[low], h[low], depth - 1), grow(codes[~low], cuts, g[~low], h[~low], depth - 1))


@dataclass
class Boosted:
    start: float
    trees: list[Tree]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.trees:
            z += RATE * t.predict(x)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Boosted on three quarters; the threshold is the lowest score with ``PRECISION`` or more on the rest.

    Without both labels, or where no threshold has that precision, nothing is added (threshold over 1)."""
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~held])) < 2:
        return Boosted(0.0, [], 2.0)
    xt, yt = x[~held], y[~held].astype(float)
    model = Boosted(float(np.log(yt.mean() / (1 - yt.mean()))), [], 2.0)
    z = np.full(len(xt), model.start)
    cuts = [cuts_of(xt[:, j]) for j in range(xt.shape[1])]
    codes = np.column_stack([np.searchsorted(c, xt[:, j], "right") for j, c in enumerate(cuts)])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        model.trees.append(grow(codes, cuts, yt - p, p * (1 - p), LEAVES_DEPTH))
        z += RATE * model.trees[-1].predict(xt)
    s, good = model.score(x[held]), y[held]
    order = np.argsort(-s, kind="stable")
    precision = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
    tied = np.append(s[order][1:] != s[order][:-1], True)  # a threshold takes all that tie with it
    fine = np.flatnonzero((precision >= PRECISION) & tied)
    if len(fine):
        model.threshold = float(max(0.5, s[order][fine[-1]]))
    return model


class Cover:
    """Places that spans take; adding and asking go by bisection."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        return bisect_right(self.ends, a) < bisect_left(self.starts, b)

    def add(self, a: int, b: int) -> None:
        """Of a span that touches none."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def made_over(kind: str, span: str, rng: random.Random) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(positives, negatives) as (words before, text), some of all: a base span in forms that base patterns miss, secrets;
    what is no personal data."""
    d = "".join(c for c in span if "0" <= c <= "9")
    cue = lambda: rng.choice(("phone", "Tel", "call", "mobile", "fax", "account", "acct", "ssn", "contact", "id")) + rng.choice((" ", ": ", " no. ", " is ", " #"))
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    date = rng.choice(("{0}-{1:02}-{2:02}", "{2:02}.{1:02}.{0}", "{1:02}/{2:02}/{0}", "{0}-{1:02}-{2:02} {3:02}")).format(rng.randint(1900, 2040), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
    amount = rng.choice((f"{rng.randint(1, 99)}.{n(rng.randint(6, 9))}", f"{rng.randint(1, 9)} {n(3)} {n(3)}", f"{rng.randint(1, 999)}.{n(3)}.{n(3)}", f"{n(3)} {n(3)} {n(3)}.{n(2)}"))
    bad = [("", date), ("", amount), ("", rng.choice("123456789") + n(rng.randint(6, 11))), (cue(), date), (cue(), n(2)), ("", f"{rng.choice(('look', 'look2', 'page.4'))} at {rng.choice(('the', 'a', 'line3'))} dot {rng.choice(('here', 'on', 'above', 'that'))}")]
    secret, announced = _secret(rng), lambda: rng.choice(("token", "api_key", "secret", "password", "access key", "Key", "auth token", "Bearer", "pwd")) + rng.choice((' = "', ": ", "=", " ", ": '"))
    words = [rng.choice(("page", "title", "index", "value", "element", "main", "review", "model", "report", "station")) for _ in range(rng.randint(3, 5))]
    joined_words = rng.choice((rng.choice("-_/").join(words) + rng.choice(("-", "_", "/v", "")) + n(rng.randint(1, 4)), words[0] + "".join(w.title() for w in words[1:]) + n(rng.randint(1, 2))))
    bad += [(rng.choice(("commit ", "sha256:", "digest ", "md5 ", "in ", "")), rng.choice((n_hex(rng, 40), n_hex(rng, 32), n_hex(rng, 64)))), ("", joined_words), (announced(), joined_words)]
    keys = [(announced(), secret), (announced(), n_hex(rng, rng.choice((32, 40, 64)))), ("", rng.choice(("AKIA", "ghp_", "sk-", "glpat-")) + _secret(rng))]
    bank = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.choice((0, 4)))) + n(4 * rng.randint(3, 5))
    land = rng.choice(("DE", "FR", "ES", "GB", "NL"))
    check = 98 - int("".join(str(int(c, 36)) for c in bank + land + "00")) % 97
    iban = f"{land}{check:02}{bank}"
    keys.append(("", rng.choice((iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))))))
    bad.append(("", f"{land}{(check + rng.randint(1, 90)) % 97:02}{bank}"))
    if kind == "email":
        name, host = span.split("@", 1)
        signs = ((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" AT ", " DOT "))
        bare = re.sub("[0-9]", "", name) or "a", re.sub("[0-9]", "", ".".join(host.split(".")[-2:]))  # names without digits, of two labels
        spelt = [("", x + at + y.replace(".", dot)) for at, dot in signs for x, y in ((name, host), bare) if ".." not in f".{y}."]
        return [*rng.sample(spelt, min(3, len(spelt))), *rng.sample(keys, 2)], rng.sample(bad, 4)
    if kind == "card":
        fours = [d[i : i + 4] for i in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        bad += [("", wrong), ("", f"{wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}")]
        good = [("", ".".join(fours)), ("", "/".join(fours)), (cue(), wrong)]
    elif kind == "ip":
        good = [(rng.choice(("ip ", "IP: ", "ip address ")), span.replace(".", "-"))]
    else:
        t = d[-10:].rjust(10, "2")
        good = [("", f"({t[:3]}) {t[3:6]}-{t[6:]}"), ("", f"{t[:3]}-{t[3:6]}-{t[6:]}"), ("", f"{t[:3]}.{t[3:6]}.{t[6:]}"), ("", f"{t[:3]} {t[3:6]} {t[6:]}"), (cue(), d), (cue(), f"{t[:3]}-{t[3:7]}")]
        if not span[1:].isdigit():
            good.append(("", span[1:]))
    e = (d * 9)[:12]
    good += [("", f"{e[:3]}-{e[3:5]}-{e[5:9]}"), (cue(), e[: rng.randint(4, 6)]), (cue(), f"{e[:4]} {e[4:8]} {e[8:]}"), (cue(), e[: rng.randint(9, 10)])]
    pair = [("", f"{d} {d}")] if kind == "card" else []  # adjacent ones, which the base pattern takes for one
    return [*pair, *rng.sample(good, 3), *rng.sample(keys, 2)], rng.sample(bad, 4)


def n_hex(rng: random.Random, k: int) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(k))


def _secret(rng: random.Random) -> str:
    """A random string of letters and digits, with one digit at least."""
    letters = rng.choice(("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    return "".join(rng.choice(letters) for _ in range(rng.randint(19, 43))) + rng.choice("23456789")


def examples(text: str) -> Iterator[tuple[list[float], bool]]:
    """(features, label) of candidates in each base span's place, under some forms of either label."""
    for kind, a, b in base_spans(text):
        rng = random.Random(f"{kind}{text[a:b]}")
        good, bad = made_over(kind, text[a:b], rng)
        left, right = _CUE.sub("word", text[max(0, a - 64) : a]), text[b : b + 64]
        for label, forms in ((True, good), (False, bad)):
            for cue, form in forms:
                tail = f" {rng.randint(1, 99_999_999)}" if label and rng.random() < 0.3 else ""  # another number that follows is no part
                made = left + cue + form + tail + right
                begin, end = len(left + cue), len(left + cue + form)
                exact = {(begin, end)}
                if kind == "card" and label and form == f"{form[: len(form) // 2]} {form[: len(form) // 2]}":
                    exact = {(begin, begin + len(form) // 2), (end - len(form) // 2, end)}
                base = Cover(base_spans(made))
                for s, e in candidates(made):
                    if s < end and begin < e and not base.touches(s, e):
                        yield features(made, s, e), label and (s, e) in exact


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Boosted:
    """From those of the about ``SCAN_DOCS`` documents with the smallest hashes of ids that have two digits or an at sign;
    at most ``SAMPLE_SPANS`` candidates come to the driver. Without any, base spans are all that will be found."""
    some = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # only the few rows of the sample are searched
    mine = hash_share(F.col("h"), docs.count(), SCAN_DOCS)
    near = some.where(F.when(mine, F.col("text").rlike("[0-9]{2}|@")))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, hs = [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for x, y in examples(text.as_py()):
                    xs.append(x)
                    ys.append(y)
                    hs.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([[float(v) for v in x] for x in xs], pa.list_(pa.float64())), pa.array(ys, pa.bool_())], names=["h", "x", "y"])

    got = near.mapInArrow(propose, "h long, x array<double>, y boolean").orderBy("h", "x", "y").limit(SAMPLE_SPANS).toPandas()
    got = got.assign(k=got.x.map(tuple)).sort_values(["h", "k"], kind="stable")
    return fit(np.array(got.x.tolist(), float).reshape(len(got), len(NAMES)), got.y.to_numpy(bool))


def find_spans(texts: list[str], model: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. Of added spans that touch, the one with the higher score stays, of equal ones
    the first, then the longest; none touches a base span."""
    base = [base_spans(t) for t in texts]
    taken = [Cover(spans) for spans in base]
    proposed = [[(i, a, b) for a, b in candidates(t) if not taken[i].touches(a, b)] for i, t in enumerate(texts)]
    flat = [c for some in proposed for c in some]
    added: list[list[Span]] = [[] for _ in texts]
    if flat and model.threshold <= 1:
        score = model.score(np.array([features(texts[i], a, b) for i, a, b in flat], float))
        good = np.flatnonzero(score >= model.threshold)
        for k in good[np.lexsort(([-flat[k][2] for k in good], [flat[k][1] for k in good], -score[good]))]:
            i, a, b = flat[k]
            if not taken[i].touches(a, b):
                taken[i].add(a, b)
                added[i].append(("other", a, b))
    return [(s, s + sorted(a, key=lambda x: x[1])) for s, a in zip(base, added)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect_pii(docs: DataFrame, model: Boosted | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row's whole text; a null text is empty.

    Offsets count code points. Spans of one kind never overlap; of two kinds they may. A null id stays null, repeated
    rows stay repeated, other columns are not read. Texts without personal data have no spans and the hash of nothing.
    Very long texts are read whole. An empty table gives an empty result; where nothing was learned, base spans only.
    """
    model = model or learn(docs, text_col, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for part in parts(batch, 1):
                for base, spans in find_spans(part.column(1).fill_null("").to_pylist(), model):
                    kinds = [k for k, _, _ in base]
                    for c, v in zip(cols, [*map(kinds.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    took = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return took.mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, model: Boosted | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text column replaced, every row and column else as it is; null texts stay null.

    Empty and very long texts, repeated rows, null ids and empty tables are no special cases."""
    model = model or learn(docs, text_col, id_col)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, where):
                column = part.column(where)
                texts = column.to_pylist()
                found = find_spans([t or "" for t in texts], model)
                new = [t if t is None else redact(t, spans) for t, (_, spans) in zip(texts, found)]
                yield part.set_column(where, part.schema.field(where), pa.array(new, column.type))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: personal data in all documents."""
    return detect_pii(table(spark, sf_dir, "documents"))
