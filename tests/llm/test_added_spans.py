"""Added spans of the secret and personal-data scans against plain versions."""

import hashlib
import math
import random
import re

import numpy as np

from cellgrain.llm import pii, secrets

from .conftest import make
from .test_spans import ROWS, brute_secrets


def ratio(text, table):
    return sum(table[ord(a) * 128 + ord(b)] for a, b in zip(text, text[1:]))


def brute_random(text, table, shortest):
    """Runs of the base64 alphabets that the models take to be random, and that no base span overlaps."""
    base = brute_secrets(text)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text, re.A):
        if len(m.group()) >= shortest and ratio(m.group(), table) >= secrets.THRESHOLD and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), m.end()))
    return out


def test_random_spans_are_those_of_plain_bigrams(spark):
    draw = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [t or "" for _, t in ROWS] + [" ".join("".join(draw.choices(alphabet, k=draw.choice([12, 16, 18, 24, 40]))) if draw.random() < 0.5 else "responsibility_of_" + draw.choice(["management", "gouvernement"]) for _ in range(6)) for _ in range(40)]
    docs = make(spark, list(enumerate(texts)))
    sample = secrets.default_sample(spark, 1500).unionByName(secrets.table_sample(docs))
    table = [float(f"{x:.4f}") for x in secrets.train(sample)]
    found = 0
    for r in secrets.scan(docs, sample).collect():
        want = brute_random(texts[r["doc_id"]], table, secrets.SHORTEST)
        assert [(x["start"], x["end"]) for x in r["random"]] == want
        found += len(want)
    assert found > 40


def test_bigram_ratios_are_those_of_plain_counts(spark):
    strings = [("abab", True), ("ba", True), ("aab", False), ("x", False)]
    table = secrets.train(spark.createDataFrame(strings, "text string, random boolean"))
    symbols = sum(chr(c).isalnum() or chr(c) in "+/_=-" for c in range(128))

    def count(kind, a, b=None):
        return sum(1 for t, k in strings if k == kind for p, q in zip(t, t[1:]) if p == a and (b is None or q == b))

    for a, b in ("ab", "ba", "aa", "xa"):
        want = math.log((count(True, a, b) + 1) / (count(True, a) + symbols)) - math.log((count(False, a, b) + 1) / (count(False, a) + symbols))
        assert abs(table[ord(a) * 128 + ord(b)] - want) < 1e-9


def test_a_table_teaches_its_own_words_and_secrets(spark, sf_dir):
    """Held out: documents that the sample has not. The small table has no secrets of its own, so some are put in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    planted = [(10_000 + i, f"Prose about it.\ntoken = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"") for i in range(60)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    table = secrets.train(secrets.default_sample(spark).unionByName(secrets.table_sample(docs.where("doc_id % 2 = 0"))))
    said = {True: [], False: []}
    for r in docs.where("doc_id % 2 = 1").collect():
        text = r["text"] or ""
        runs = [run for s, _, e in brute_secrets(text) for run in re.findall(r"[A-Za-z0-9+/_=-]{16,}", text[s:e])]
        said[True] += [ratio(run, table) >= secrets.THRESHOLD for run in runs if not run.isdigit()]
        said[False] += [ratio(w, table) >= secrets.THRESHOLD for w in re.findall(r"(?<![A-Za-z0-9+/_=-])[a-z]{16,}(?![A-Za-z0-9+/_=-])", text)]
    assert len(said[True]) >= 30 and np.mean(said[True]) > 0.95
    assert not said[False] or np.mean(said[False]) < 0.02


def test_trees_walk_as_plain_comparisons():
    """A candidate's probability is the calibrated sum over all trees, walked one by one."""
    model = pii.model()
    for text, s, e, kind, _ in pii.sample(60, seed=12):
        if s == e:
            continue
        x, z = pii.features(text, s, e, kind), model.trees.bias
        for node in model.trees.trees:
            while isinstance(node, tuple):
                j, cut, low, high = node
                node = low if x[j] <= cut else high
            z += node
        assert abs(model.probability(text, s, e, kind) - 1 / (1 + math.exp(-(model.slope * z + model.shift)))) < 1e-12


def test_added_personal_spans_are_those_of_plain_choice(spark):
    """Candidates at or above their kind's threshold, the likeliest first, that overlap no base span and no likelier one."""
    texts = [r[0] for r in pii.sample(80, seed=21)] + [t or "" for _, t in ROWS]
    model = pii.model()
    for r in pii.scan(make(spark, list(enumerate(texts)))).collect():
        text = texts[r["doc_id"]]
        spans = pii.base_spans(text)
        taken = [(s, e) for s, _, e in spans]
        options = []
        for kind, pattern in pii.PROPOSE.items():
            for m in pattern.finditer(text):
                p = 1 / (1 + math.exp(-(model.slope * model.trees.margin(pii.features(text, m.start(), m.end(), kind)) + model.shift)))
                if p >= model.threshold[kind]:
                    options.append((-p, m.start(), pii.KINDS.index(kind), m.end()))
        for _, s, k, e in sorted(options):
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                spans.append((s, k, e))
        assert [(x["start"], pii.KINDS.index(x["kind"]), x["end"]) for x in r["spans"]] == sorted(spans)
