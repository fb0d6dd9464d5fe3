"""Toxicity by weak supervision.

1. Many voters look at a text. Lexicon voters are words and word beginnings: fixed lists in the four
   languages, and those that a bounded sample of labelled training rows shows to go with
   toxic texts (of several that say the same, the most specific one). Pattern voters look
   for abuse said to a reader, names called, orders to be silent, threats, shouting and repetition.
2. A generative label model with a latent class estimates, for every voter, how often it fires for either class, and
   which voters fire together beyond what the class explains; correlated voters share their weight. The
   annotator is one of the voters: how often a label is wrong is estimated like the rest, from how well labels go
   with what the others say, so a wrong label is outvoted. The model's posteriors are soft labels.
3. A linear classifier (logistic regression over the lexicon entries and patterns) is trained on the posteriors
   and calibrated on them.

The sample holds at most ``TOXIC_ROWS`` rows labelled 1 and ``CLEAN_ROWS`` labelled 0, those of least seeded hash,
one text for an id; weights restore the classes' shares. Executors look for signs and count them; the driver gets the signs that
pass a test of significance, and how many sampled rows fire which voters. All else covers all rows: every text is scored
whole, by the text alone.

Defined results: a null text counts as empty and scores like any text without a sign
of toxicity; repeated rows score alike; of rows that share an id, one (of least hash) is in the sample; a document with two
labels counts by the larger; labels and ids that are null are left out of the sample; without training rows of both classes the
fixed lists alone decide; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

TOXIC_ROWS, CLEAN_ROWS, SEED = 4000, 8000, 7
THRESHOLD = 0.3

# Common insults, by language.
INSULTS = (
    "bastard", "clown", "coward", "cretin", "disgusting", "dumbass", "fool", "freak", "garbage", "idiot", "imbecile", "jerk",
    "liar", "loser", "lowlife", "moron", "parasite", "pathetic", "pig", "rat", "scum", "scumbag", "stupid", "trash", "vermin",
    "vile", "worthless", "wretch",
)
INSULTS_DE = ("abschaum", "arschloch", "blödmann", "dummkopf", "drecksau", "ekelhaft", "feigling", "idioten", "lügner", "mistkerl", "schwachkopf", "trottel", "versager", "wertlos")
INSULTS_FR = ("abruti", "connard", "crétin", "dégoûtant", "imbécile", "lâche", "menteur", "minable", "ordure", "raclure", "salaud", "stupide", "vermine")
INSULTS_ES = ("asqueroso", "basura", "cobarde", "escoria", "estúpido", "gilipollas", "idiota", "imbécil", "inútil", "mentiroso", "patético", "payaso", "perdedor")
EVERY_INSULT = tuple(dict.fromkeys(INSULTS + INSULTS_DE + INSULTS_FR + INSULTS_ES))

# Words said to and about a reader, orders to be silent, and threats.
TO_READER = {"you": "you|your|du|ihr|tu|vous|eres", "you_de": "du|dich|dir|ihr|euch|sie", "you_fr": "tu|toi|vous|espèce", "you_es": "eres|tú|usted|ustedes|sois"}
SILENCE = ("shut up", "shut your mouth", "halt die klappe", "halt die fresse", "ferme-la", "ta gueule", "cállate", "cierra la boca")
THREATS = ("kill you", "hurt you", "find you", "bring dich um", "mach dich fertig", "vais te tuer", "vais te trouver", "voy a matar", "te mataré")


def _one_of(words) -> str:
    return r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"


_INSULT = _one_of(EVERY_INSULT)
PATTERNS = {
    **{f"?{name}": re.compile(rf"\b(?:{who})\b[^.!?\n]{{0,40}}{_one_of(INSULTS if name == 'you' else EVERY_INSULT)}", re.I) for name, who in TO_READER.items()},
    "?shout": re.compile(_one_of(w.upper() for w in INSULTS) + "[!?]"),
    "?shout_all": re.compile(_one_of(w.upper() for w in EVERY_INSULT)),
    "?cry": re.compile(_INSULT + r"\s*!", re.I),
    "?called": re.compile(r"\b(?:such an?|what an?|so eine?|quelle?|qué|vaya)\s+" + _INSULT, re.I),
    "?like": re.compile(r"\b(?:like|wie|comme|como)\s+(?:an?|ein|eine|une?|una)?\s*" + _INSULT, re.I),
    "?pair": re.compile(_INSULT + r"\W{1,3}" + _INSULT, re.I),
    "?twice": re.compile(_INSULT + r"[^\n]*" + _INSULT, re.I),
    "?often": re.compile(rf"(?:{_INSULT}(?s:.*?)){{4}}", re.I),
    "?first": re.compile(r"\A\W*" + _INSULT, re.I),
    "?last": re.compile(_INSULT + r"\W*\Z", re.I),
    "?alone": re.compile(r"[.!?\n]\s*" + _INSULT + r"\s*[.!?\n]", re.I),
    "?silence": re.compile(_one_of(SILENCE), re.I),
    "?threat": re.compile(_one_of(THREATS), re.I),
}
#: Of each pattern, the words of which a text that matches bears one.
_NEEDS = {k: frozenset(EVERY_INSULT) for k in PATTERNS} | {"?silence": frozenset(("shut", "halt", "ferme", "gueule", "cállate", "cierra")), "?threat": frozenset(("you", "dich", "te", "voy"))}
_TELLING = frozenset().union(*_NEEDS.values())
_WORD = re.compile(r"[^\W\d_]+")


#: A beginning's sign bears a mark for each of these counts that its words reach in the text.
TIMES = (2, 4)


def fired(text: str, words) -> list[str]:
    """The patterns that a text of these words matches."""
    near = _TELLING.intersection(words)
    return [k for k, p in PATTERNS.items() if near and not near.isdisjoint(_NEEDS[k]) and p.search(text)] if near else []


def signs(text: str) -> set[str]:
    """Every sign a lexicon entry may be: whole words as ``=word``, beginnings of 4 to 7 letters as they are,
    and with a ``+`` for each count of ``TIMES`` that words so beginning reach."""
    words = Counter(_WORD.findall(text.lower()))
    begin: Counter[str] = Counter()
    for word, n in words.items():
        for k in (4, 5, 6, 7):
            if len(word) >= k:
                begin[word[:k]] += n
    out = {"=" + w for w in words} | set(begin)
    for i, least in enumerate(TIMES, 1):
        out |= {w + "+" * i for w, n in begin.items() if n >= least}
    return out


class Model:
    """Weights of signs and patterns, and a bias: what executors need."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.whole = {k[1:]: v for k, v in weights.items() if k[0] == "="}
        self.begin: dict[str, list[tuple[int, float]]] = {}
        for k, v in weights.items():
            if k[0] not in "=?":
                self.begin.setdefault(k.rstrip("+"), []).append(((1, *TIMES)[k.count("+")], v))
        self.patterns = [(_NEEDS[k], PATTERNS[k], v) for k, v in weights.items() if k[0] == "?"]
        self.lengths = sorted({len(k) for k in self.begin})

    def score(self, text: str | None) -> float:
        text = text or ""
        z, begun = self.bias, Counter()
        whole, begin = self.whole, self.begin
        words = Counter(_WORD.findall(text.lower()))
        for word, n in words.items():
            if word in whole:
                z += whole[word]
            for k in self.lengths:
                if (start := word[:k]) in begin and len(start) == k:
                    begun[start] += n
        for start, n in begun.items():
            z += sum(w for least, w in begin[start] if n >= least)
        near = _TELLING.intersection(words)
        if near:
            z += sum(w for needs, p, w in self.patterns if not near.isdisjoint(needs) and p.search(text))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _sketch(found: set[str]) -> int:
    """Alike for copies and most near copies of a text."""
    long = [w for w in found if w[0] == "=" and len(w) > 8] or list(found) or [""]
    return min(zlib.crc32(w.encode()) for w in long)


def _most_specific(lift: dict[str, tuple[float, int]]) -> list[str]:
    """Of signs with their gain and the toxic rows that bear them, the strongest first, those that no other makes needless."""
    families: dict[str, list[str]] = {}
    for t in lift:
        families.setdefault(t.strip("=+")[:4], []).append(t)
    best = []
    for s in sorted(lift, key=lambda s: (-lift[s][0], s)):
        n, word = lift[s][1], s.strip("=+")
        kin = [t for t in families[word[:4]] if t != s]
        narrower = [t for t in kin if s[0] != "=" and t.strip("=+").startswith(word) and t.count("+") >= s.count("+")]
        wider = [t for t in kin if t[0] != "=" and word.startswith(t.rstrip("+")) and t.strip("+") != word and lift[t][0] > lift[s][0]]
        if any(lift[t][1] >= 0.8 * n and lift[t][0] >= lift[s][0] for t in narrower) or any(lift[t][1] > 1.25 * n for t in wider):
            continue
        best.append(s)
    return best


def _mine(signed: DataFrame) -> list[str]:
    """Signs that go with toxic rows, the strongest first, without those that a more specific one makes needless.

    ``signed`` has y, sketch and signs. Copies count once. A sign must be rarer among chance findings than one in twenty:
    the bound on the chance of its counts, times the number of signs, is below 0.05. All signs that pass are taken.
    """
    once = signed.groupBy("y", "sketch").agg(F.min_by("signs", "id").alias("signs"))
    sizes = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    counts = once.select("y", F.explode("signs").alias("sign")).groupBy("sign").agg(F.sum("y").alias("n"), F.sum(1 - F.col("y")).alias("m"))
    tried = max(1, counts.where("n > 0").count())
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    part, rest = F.col("n") / (F.col("n") + F.col("m")), F.col("m") / (F.col("n") + F.col("m"))
    gain = F.col("n") * F.log(part / share) + F.when(F.col("m") > 0, F.col("m") * F.log(rest / (1 - share))).otherwise(0.0)
    passed = counts.where(F.col("n") >= 3).where(part > max(0.6, share)).withColumn("gain", gain).where(F.col("gain") >= float(np.log(20.0 * tried)))
    return _most_specific({r["sign"]: (r["gain"], r["n"]) for r in passed.collect()})


def label_model(votes: np.ndarray, said: np.ndarray, prior: float, weight: np.ndarray | None = None, rounds: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the latent class, rates at which voters fire [class, voter; the annotator last], and voters' correlations given the class.

    ``votes`` is 0/1, a row for each text (or, with ``weight``, for so many texts): a voter fires for the toxic class or abstains.
    The votes of a text are Poisson counts with its class's rates: a vote speaks by the ratio of its voter's rates, and what
    the class leads one to expect in all is held against few votes, so that one voter's silence among very many says next to nothing.
    ``said`` holds the annotator's votes, who never abstains. Expectation maximisation, begun at the labels (with doubt where no voter fires); the share of the classes (``prior``
    at first) and all rates, the annotator's too, are estimated. Voters that fire together beyond what the class explains share their weight.
    """
    rows, k = votes.shape
    weight = np.ones(rows) if weight is None else np.asarray(weight, dtype=float)
    any_ = votes.any(axis=1)
    post = np.where(said == 1, np.where(any_, 0.9, 0.4), 0.05)
    share, corr = np.ones(k), np.zeros((k, k))
    for step in range(rounds):
        p = np.stack([1 - post, post]) * weight
        total = p.sum(axis=1, keepdims=True)
        rate = np.clip((p @ votes + [[0.05], [0.1]]) / (total + 1), 1e-6, 1 - 1e-6)
        label = np.clip((p @ (said == 1) + [0.1, 0.9]) / (total[:, 0] + 1), 1e-4, 1 - 1e-4)
        log = votes @ (share * np.log(rate[1] / rate[0])) - share @ (rate[1] - rate[0])
        log += np.where(said == 1, np.log(label[1] / label[0]), np.log((1 - label[1]) / (1 - label[0])))
        new = 1 / (1 + np.exp(-np.clip(log + np.log(prior / (1 - prior)), -30, 30)))
        prior = float(np.clip((weight @ new + 0.5) / (weight.sum() + 1), 1e-4, 1 - 1e-4))
        if step in (5, 15):  # correlations left over once the class is taken out
            left = votes - np.outer(new, rate[1]) - np.outer(1 - new, rate[0])
            scale = np.sqrt((weight @ left**2) / weight.sum()) + 1e-9
            corr = (left.T * weight) @ left / weight.sum() / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            share = _share(corr)
        done = step > 16 and np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, np.column_stack([rate, label]), corr


def _share(corr: np.ndarray) -> np.ndarray:
    """The part of its weight that each voter keeps."""
    return 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, start: np.ndarray, floor: float | None = None, steps: int = 400) -> np.ndarray:
    """Weighted ridge logistic regression by accelerated gradient steps; the last column is the bias, which has no ridge."""
    theta, ahead, w = start.copy(), start.copy(), w / w.sum()
    rate = 4 / (np.abs(x).sum(axis=1).max() + 4 * ridge)
    free = np.ones(len(theta))
    free[-1] = 0
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (w * (p - y)) + ridge * free * ahead)
        if floor is not None:
            new[:-1] = np.maximum(new[:-1], floor)
        ahead = new + t / (t + 3) * (new - theta)
        theta = new
    return theta


#: What decides where there is nothing to learn from.
UNTRAINED = ({"=" + w: 4.0 for w in EVERY_INSULT}, -3.0)


def fit(voters: list[str], rows: list[tuple[int, tuple[int, ...], int]], shares: tuple[float, float]) -> Model:
    """The model from rows (label, indices of the voters that fire, number of such texts). shares: rows that a sampled clean and toxic row stand for."""
    said = np.array([y for y, _, _ in rows], dtype=np.int64)
    often = np.array([n for _, _, n in rows], dtype=float)
    if not 0 < said.sum() < len(said):
        return Model(*UNTRAINED)
    votes = np.zeros((len(rows), len(voters)))
    for i, (_, at, _) in enumerate(rows):
        votes[i, list(at)] = 1
    post, rate, corr = label_model(votes, said, float(np.clip(often @ said / often.sum(), 0.005, 0.995)), often)
    # A row stands for as many as its label's class was sampled from.
    weight = often * np.where(said == 1, shares[1], shares[0])
    prior = float(np.clip(weight @ post / weight.sum(), 0.005, 0.5))
    start = np.append(_share(corr) * np.log(rate[1, :-1] / rate[0, :-1]), np.log(prior / (1 - prior)) - 1)
    x = np.hstack([votes, np.ones((len(rows), 1))])
    # Mined entries don't argue for the clean class: what they say is that a sign is there.
    theta = _logistic(x, post, weight, 1e-5, start, floor=0.0, steps=2000)
    z = x @ theta
    # Platt scaling on the posteriors, smoothed so that a perfect split stays finite.
    n1, n0 = often @ post, often @ (1 - post)
    target = post * (n1 + 1) / (n1 + 2) + (1 - post) / (n0 + 2)
    spread = z.std() or 1.0
    slope, shift = _logistic(np.stack([z / spread, np.ones(len(z))], axis=1), target, weight, 0.0, np.array([spread, 0.0]), steps=1000)
    slope = max(slope, 0.1) / spread
    return Model({n: float(v * slope) for n, v in zip(voters, theta) if v * slope > 1e-3}, float(theta[-1] * slope + shift))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _signed(batches) -> Iterator:
    """id, y, sketch, signs and patterns of batches of (id, y, text)."""
    import pyarrow as pa

    for batch in batches:
        found = [(signs(t), t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([_sketch(f) for f, _ in found], pa.int64()), pa.array([sorted(f) for f, _ in found], pa.list_(pa.string())),
                pa.array([fired(t, [w[1:] for w in f if w[0] == "="]) for f, t in found], pa.list_(pa.string())),
            ],
            names=["id", "y", "sketch", "signs", "patterns"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows outside the held-out quarter."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # Of bounded size: the ids of the sample, and a text for each.
    sample = known.where("y = 1").orderBy(order, "id").limit(TOXIC_ROWS).union(known.where("y = 0").orderBy(order, "id").limit(CLEAN_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = checkpoint(rows.mapInArrow(_signed, f"id {id_type}, y int, sketch bigint, signs array<string>, patterns array<string>"))
    mined = _mine(signed)
    lexicon = mined + [e for e in ("=" + w for w in EVERY_INSULT) if e not in set(mined)]
    voters = lexicon + list(PATTERNS)
    at = {v: i for i, v in enumerate(voters)}
    # Which voters fire, and for how many sampled texts; no texts.
    votes = signed.select("y", F.array_intersect("signs", F.split(F.lit(" ".join(lexicon)), " ")).alias("signs"), "patterns")
    votes = votes.groupBy("y", F.array_sort("signs").alias("signs"), "patterns").count().collect()
    rows = sorted((r["y"], tuple(sorted(at[v] for v in [*r["signs"], *r["patterns"]])), r["count"]) for r in votes)
    took = {y: sum(n for label, _, n in rows if label == y) for y in (0, 1)}
    return fit(voters, rows, tuple(sizes.get(y, 0) / max(1, took[y]) for y in (0, 1)))


def scorer(docs: DataFrame, model: Model):
    """A column function: the score of a text column."""
    known = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*known.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    score = scorer(docs, train(docs, labels, id_col, text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns unchanged."""
    score = scorer(docs, train(docs, labels, id_col, text_col))
    return docs.where(score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < THRESHOLD)
