import hashlib
import random
import re

import pytest

from cellgrain.llm import fingerprint as fp

from .conftest import make


def jaccard(a, b):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n=60, seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out, base = [], []
    for i in range(n):  # a text of its own kind, then two variants of one base, whose errors don't hang on other bases
        base = draw.choices(words, k=700) if i % 3 == 0 else base
        own = list(base) if i % 3 else draw.choices(words, k=draw.choice([3, 8, 40, 400, 3000]))
        for _ in range(draw.choice([0, 5, 40, 200])):
            own[draw.randrange(len(own))] = draw.choice(words)
        out.append(" ".join(own))
    return out


def test_likeness_estimates_jaccard(spark):
    rows = texts()
    docs = make(spark, [(3 * i + 7, t) for i, t in enumerate(rows)])
    got = {r["doc_id"]: r for r in fp.with_next(docs).collect()}
    wrong = []
    for i, t in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[3 * i + 7]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["next_id"] == 3 * ((i + 1) % len(rows)) + 7
        wrong += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, nxt)]
    # One estimate errs by up to (0.25 / 256) ** 0.5 = 0.031; the mean of about 120 by 0.003.
    assert abs(sum(wrong) / len(wrong)) < 0.01
    assert (sum(w * w for w in wrong) / len(wrong)) ** 0.5 < 0.05


def test_equal_texts_and_edges(spark, edges, empty):
    got = [(r["doc_id"], r["fingerprint"], r) for r in fp.with_next(edges).collect()]
    assert len(got) == edges.count()
    of = {}
    for text, finger in [(r["text"] or "", f["fingerprint"]) for r, f in zip(edges.orderBy("doc_id").collect(), sorted((g[2] for g in got), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))) if r["doc_id"] not in (None, 7)]:
        assert of.setdefault(text, finger) == finger
    blank = [f for i, f, _ in got if i in (1, 2, 3)]
    assert set(blank) == {fp.NOTHING}
    assert all(len(f) == 512 and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for _, f, r in got)
    assert fp.with_next(empty).count() == 0 and fp.fingerprints(empty).count() == 0


def test_a_sole_document_succeeds_itself(spark):
    r = fp.with_next(make(spark, [(4, "abc def ghi jkl mno pqr")])).first()
    assert r["next_id"] == 4 and r["near_next"] == 1.0
    assert r["edited_sha256"] == hashlib.sha256(("abc def ghi jkl mno pqr"[:12] + "abc def ghi").encode()).hexdigest()


def test_fingerprint_does_not_depend_on_the_partition(spark):
    docs = make(spark, [(i, t) for i, t in enumerate(texts(30))])
    a = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs).collect()}
    b = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(docs.repartition(7, "text")).collect()}
    assert a == b


@pytest.mark.parametrize("words", [1, 4, 5, 6, 30])
def test_short_texts(spark, words):
    t = " ".join(f"u{i}" for i in range(words))
    rows = fp.with_next(make(spark, [(1, t), (2, t), (3, t + " more")])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0 and by[2]["near_next"] < 1.0
