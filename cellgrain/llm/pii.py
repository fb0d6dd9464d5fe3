"""Personal data by candidate spans and gradient-boosted trees.

Generators of high recall propose overlapping spans: base rules for e-mail and IP addresses,
payment cards and international phone numbers, and looser shapes (obfuscated addresses,
national phone numbers, social security numbers, IBANs). Base spans that pass their
checks always stay. The other candidates are scored by boosted regression trees over
format features (digit groups, check digits, separators, length) and context features
(words before the span); where the calibrated probability reaches a kind's threshold, and
no stronger span overlaps, the span is added under a kind of its own.

The trees are trained here, on a generated labelled sample (``sample``): spans in sentences
with and without personal data of the same shapes (part numbers, versions, amounts, dates).
A held-out part of it fits the calibration (Platt) and the thresholds, the least ones whose
precision there is ``PRECISION`` or more. Model and sample have a fixed size; the model is trained on the
driver, so that all tasks use the same numbers, and broadcast.

Base matching looks for leftmost non-overlapping matches, failing ones dropped without a
retry, in one pass for each kind whatever the text's length; offsets are in code points.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned
each; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns. The lookbehinds only spare starts that can't match, as a run's first character would have.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_AT = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "email_obfuscated", "phone_national", "ssn", "iban")
BASE = KINDS[:4]

PROPOSE = {
    "email_obfuscated": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]+)+", re.I),
    "phone_national": re.compile(
        r"(?<![0-9+.-])(?:"
        r"0[0-9](?:[ .-][0-9]{2}){4}"  # 01 23 45 67 89
        r"|\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,5}"
        r"|\(0?[0-9]{2,4}\)[0-9]{3,4}[ .-][0-9]{3,5}"  # (555)123-4567
        r"|\(?0[0-9]{2,4}\)?[ /-][0-9]{5,8}"  # 030 1234567
        r")(?![0-9-]|\.[0-9])"
    ),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
PRECISION, SAMPLE, SEED = 0.98, 6000, 5

# Words that stand before personal data, and before other numbers.
PERSONAL = "phone tel telephone mobile cell call fax contact reach mail email write ssn social security iban account bank transfer telefon handy anruf konto appel compte cuenta llame".split()
OTHER = "part order invoice version serial model isbn item no number ref case ticket figure page article amount total price rev build lot batch sku date".split()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``local@domain``, found from each at sign: the local part is the run before it, down to the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _iban(text: str) -> bool:
    flat = text.replace(" ", "")
    turned = flat[4:] + flat[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """What the trees see of a candidate: its format, and the words before and the characters around it."""
    span, digits = text[start:end], _digits(text[start:end])
    before = re.findall(r"[a-z]+", text[max(0, start - 60) : start].lower())[-4:]
    after = text[end : end + 1]
    return [
        float(list(PROPOSE).index(kind)), float(end - start), float(len(digits)), float(len(set(digits))),
        float(sum(c.isalpha() for c in span)), float(sum(c in " .-/()[]" for c in span)), float(len(set(re.findall(r"[ ./-]", span)))),
        float(span[:1] in "(0"), float(luhn(digits)) if digits else 0.0, float(kind == "iban" and _iban(span)),
        float(kind == "ssn" and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
        float(digits == "".join(sorted(digits))), float(sum(w in PERSONAL for w in before)), float(sum(w in OTHER for w in before)),
        float(bool(before) and before[-1] in PERSONAL), float(bool(before) and before[-1] in OTHER), float(text[max(0, start - 2) : start].strip() in (":", "#", "=")),
        float(after.isalnum()), float(start > 0 and text[start - 1].isalnum()), float(start > 0 and text[start - 1] in "#$€"),
    ]


class Trees:
    """Logistic gradient boosting with small trees, exact splits over quantile cuts."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list = []
        self.bias = 0.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = -g.sum() / (h.sum() + 1.0) * self.rate
        if depth == 0 or len(g) < 2 * self.least:
            return value
        best, score = None, g.sum() ** 2 / (h.sum() + 1.0) + 1e-6
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1], method="lower")):
                left = x[:, j] <= cut
                if self.least <= left.sum() <= len(g) - self.least:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0)
                    if gain > score:
                        best, score = (j, float(cut), left), gain
        if best is None:
            return value
        j, cut, left = best
        return j, cut, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            self.trees.append(self._grow(x, p - y, p * (1 - p), self.depth))
            z += np.array([self._walk(self.trees[-1], row) for row in x])
        return self

    @staticmethod
    def _walk(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row) -> float:
        return self.bias + sum(self._walk(t, row) for t in self.trees)


def _with_check(country: str, body: str) -> str:
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def sample(rows: int = SAMPLE, seed: int = SEED) -> list[tuple[str, int, int, str, int]]:
    """Generated (text, start, end, kind, personal) rows, half of each label. A real span that no generator proposes whole is a miss: start and end are alike."""
    draw, more = random.Random(seed), random.Random(seed + 1)
    filler = "the of and we that when note please see was on here old new they this with for".split()

    def number(n: int, by: random.Random = draw) -> str:
        return "".join(by.choice("0123456789") for _ in range(n))

    def regrouped(kind: str, real: bool, body: str) -> str:
        """Some telephone and account numbers in other groupings, and others of like shapes. Drawn apart, so that the other rows stay as they are."""
        if kind == "phone_national" and more.random() < 0.4:
            if real:
                return more.choice([f"({number(3, more)}){number(3, more)}-{number(4, more)}", f"0{number(2, more)} {number(7, more)}", " ".join(["0" + number(1, more), *(number(2, more) for _ in range(4))])])
            return more.choice([f"({number(2, more)}){number(4, more)}-{number(5, more)}", f"0{number(4, more)}-{number(8, more)}", "-".join(["0" + number(1, more), *(number(2, more) for _ in range(4))])])
        if kind == "iban" and more.random() < 0.3:
            short = number(more.choice([11, 12]), more)
            flat = _with_check(more.choice(["NO", "BE"]), short) if real else more.choice(["AB", "SN", "XK", "NO"]) + number(2, more) + short
            return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if more.random() < 0.6 else flat
        return body

    def span(kind: str, real: bool) -> str:
        if kind == "email_obfuscated":
            names = ["anna", "j.smith", "info", "bob77", "kontakt", "m_lee"] if real else ["look", "meet", "stay", "arrive", "was", "x"]
            hosts = ["example", "mail", "post-box", "corp"] if real else ["noon", "home", "the", "night"]
            ends = [" [dot] com", " (dot) org", ".net", "(dot)de"] if real else [".And", ".The", ".v2", " (dot) dot"]
            return draw.choice(names) + draw.choice([" [at] ", " (at) ", "(at)"]) + draw.choice(hosts) + draw.choice(ends)
        if kind == "phone_national":
            if real:
                return draw.choice([f"({number(3)}) {number(3)}-{number(4)}", f"0{number(2)} {number(4)} {number(4)}", f"{draw.choice('23456789')}{number(2)}-{number(3)}-{number(4)}", f"0{number(3)}/{number(3)}-{number(3)}"])
            return draw.choice([f"{number(2)}.{number(3)}.{number(3)}", f"{number(4)}-{number(3)}-{number(3)}", f"{number(2)} {number(3)} {number(3)}", f"{number(3)}-{number(4)}-{number(5)}"])
        if kind == "ssn":
            return f"{draw.choice('12345')}{number(2)}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}" if real else draw.choice([f"000-{number(2)}-{number(4)}", f"9{number(2)}-{number(2)}-{number(4)}", f"{number(3)}-{number(2)}-{number(4)}"])
        body = number(18)
        flat = _with_check(draw.choice(["DE", "FR", "ES", "GB"]), body) if real else draw.choice(["AB", "SN", "XK", "DE"]) + number(2) + body
        return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if draw.random() < 0.6 else flat

    out = []
    for i in range(rows):
        kind, real = list(PROPOSE)[i % len(PROPOSE)], draw.random() < 0.5
        cue = draw.random()
        words = draw.choices(filler, k=draw.randint(2, 6))
        if cue < 0.7:
            words.append(draw.choice(PERSONAL if real else OTHER))
        elif cue < 0.75:
            words.append(draw.choice(OTHER if real else PERSONAL))
        head = " ".join(words) + draw.choice([" ", ": ", " # "] if not real else [" ", ": "])
        body = regrouped(kind, real, span(kind, real))
        text = head + body + draw.choice([" ", ". ", ", "]) + " ".join(draw.choices(filler, k=4))
        m, end = PROPOSE[kind].search(text), len(head) + len(body)
        if real and not (m and m.start() <= len(head) and m.end() >= end):
            out.append((text, len(head), len(head), kind, 1))
        elif m and m.end() > len(head) and m.start() < end:
            out.append((text, m.start(), m.end(), kind, int(real)))
    return out


def _held(text: str) -> bool:
    return int(hashlib.md5(text.encode()).hexdigest(), 16) % 3 == 0


class Model:
    """Trees, calibration and thresholds by kind; recall by kind on held-out rows, where misses of the generators count."""

    def __init__(self, rows: list[tuple[str, int, int, str, int]]):
        missed = [r for r in rows if r[1] == r[2]]  # nothing there for the trees to score
        rows = [r for r in rows if r[1] < r[2]]
        x = np.array([features(*r[:4]) for r in rows])
        y = np.array([r[4] for r in rows], dtype=float)
        held = np.array([_held(r[0]) for r in rows])
        self.trees = Trees().fit(x[~held], y[~held])
        z = np.array([self.trees.margin(row) for row in x[held]])
        self.slope, self.shift = 1.0, 0.0
        for _ in range(500):  # Platt scaling
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            self.slope -= 0.05 * float((z * (p - y[held])).mean())
            self.shift -= 0.05 * float((p - y[held]).mean())
        p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
        self.threshold, self.recall = {}, {}
        kinds = np.array([r[3] for r in rows])[held]
        for kind in PROPOSE:
            own, truth = p[kinds == kind], y[held][kinds == kind]
            fit = [t for t in np.linspace(0.5, 0.99, 50) if (own >= t).any() and truth[own >= t].mean() >= PRECISION]
            self.threshold[kind] = float(min(fit, default=0.99))
            lost = sum(r[3] == kind and _held(r[0]) for r in missed)
            self.recall[kind] = float((truth[own >= self.threshold[kind]]).sum() / max(1.0, truth.sum() + lost))

    def probability(self, text: str, start: int, end: int, kind: str) -> float:
        if start == end:
            return 0.0  # a miss of ``sample``
        return 1 / (1 + math.exp(-(self.slope * self.trees.margin(features(text, start, end, kind)) + self.shift)))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans (start, kind, end): the base ones, and added ones that overlap neither them nor a likelier one."""
        base = base_spans(text)
        added = []
        for kind, pattern in PROPOSE.items():
            if kind == "email_obfuscated" and not _AT.search(text):
                continue
            for m in pattern.finditer(text):
                if (p := self.probability(text, m.start(), m.end(), kind)) >= self.threshold[kind]:
                    added.append((-p, m.start(), KINDS.index(kind), m.end()))
        if not added:
            return base
        taken = sorted((s, e) for s, _, e in base)
        out = list(base)
        for _, s, k, e in sorted(added):
            if not any(a < e and s < b for a, b in taken):
                taken.append((s, e))
                out.append((s, k, e))
        return sorted(out)


@functools.cache
def model() -> Model:
    return Model(sample())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of struct(kind, start, end), sorted by start and kind."""

    known = docs.sparkSession.sparkContext.broadcast(model())  # trained once, on the driver; some KB

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = known.value
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own.spans(t)] for t in texts])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), found(text).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def number(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return scanned.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; overlapping spans by that which starts first."""

    known = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = known.value
        for texts in batches:
            out = []
            for t in texts:
                parts, at = [], 0
                for s, k, e in own.spans(t):
                    if s >= at:
                        parts += [t[at:s], f"[{KINDS[k]}]"]
                    at = max(at, e)
                out.append("".join(parts) + t[at:])
            yield pd.Series(out)

    return docs.select(F.col(id_col).alias("doc_id"), cut(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
