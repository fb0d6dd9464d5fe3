"""Segmentation and classes held against plain versions, and the public vocabulary's words."""

import itertools
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from cellgrain.llm import url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    return url_filter.dictionary(VOCABULARY)


def cost_of(parts, counts, total):
    """Cost of a cut into listed words and unlisted stretches, which never stand side by side."""
    out, stray = 0.0, False
    for p in parts:
        if p in counts:
            out, stray = out - math.log(counts[p] / total), False
        elif stray:
            return math.inf
        else:
            out, stray = out + math.log(total) + 2 + 2.5 * len(p), True
    return out


def cuts(run):
    for marks in itertools.product((False, True), repeat=len(run) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def test_segmentation_is_the_cheapest_of_all():
    draw = random.Random(5)
    counts = {"ab": 5, "abc": 3, "c": 9, "ca": 2, "bca": 4, "b": 1}
    model = url_filter.Model([(" ".join([w] * n), 0) for w, n in counts.items()])
    total = sum(counts.values())
    for _ in range(60):
        run = "".join(draw.choices("abcx", k=draw.randint(1, 9)))
        got = model.segment(run)
        assert "".join(got) == run
        assert cost_of(got, counts, total) == pytest.approx(min(cost_of(p, counts, total) for p in cuts(run)))


def test_classes_are_those_of_plain_bayes():
    rows = [("cheap pills", 1), ("cheap win", 1), ("news wiki", 0), ("wiki wiki pills", 0)]
    model = url_filter.Model(rows, prior=0.3)
    by = {y: Counter(w for t, label in rows if label == y for w in t.split()) for y in (0, 1)}
    vocabulary = set(by[0]) | set(by[1])
    for words in (["cheap"], ["wiki", "pills"], ["other"], ["cheap", "wiki", "cheap"]):
        want = math.log(0.3 / 0.7)
        for w in words:
            if w in vocabulary:
                want += math.log((by[1][w] + 1) / (sum(by[1].values()) + len(vocabulary) + 1)) - math.log((by[0][w] + 1) / (sum(by[0].values()) + len(vocabulary) + 1))
        assert model.score_of(words) == pytest.approx(want)


def test_names_of_words_that_no_list_has(known):
    """Two or three words of the vocabulary, run together: the listed training words are left out."""
    listed = set(url_filter.UNWANTED) | set(url_filter.WANTED)
    words = [w for w in known if len(w) >= 4 and w not in listed][:8000]
    model, draw = url_filter.Model(url_filter.training(), counts=known), random.Random(1)
    names = [[draw.choice(words) for _ in range(draw.choice((2, 2, 3)))] for _ in range(500)]
    assert sum(model.segment("".join(n)) == n for n in names) / len(names) > 0.95
    assert model.segment("onlinegambling") == ["online", "gambling"] and model.segment("mayoclinic") == ["mayo", "clinic"]
    assert model.verdict("onlinegambling.biz", "/") == model.verdict("slotmachine777.com", "/") == "block"
    assert model.verdict("creditunion.org", "/") == model.verdict("mayoclinic.org", "/") == "allow"


def test_words_of_all_pages_count(spark, known):
    texts = ["<p>Gambling gambling</p>", None, "", "clinic " * 3000, "zzqq gambling"]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string").repartition(3)
    got = url_filter.count(pages, known)
    own = Counter(w for t in texts for w in re.findall("[a-z]+", (t or "").lower()))
    assert got.keys() == known.keys() and all(got[w] == pytest.approx(known[w] + own[w]) for w in known)


def test_rows_that_repeat_and_rows_that_a_rule_decides(spark):
    urls = ["https://mayoclinic.com/a"] * 3 + ["http://x.net/casino"] * 2 + [None]
    pages = spark.createDataFrame([(1, u, "some words", "x") for u in urls], "page_id long, url string, html string, score string")
    rows = url_filter.judge(pages, vocabulary=VOCABULARY).collect()
    assert len(rows) == 6 and len({(r["host"], r["verdict"], r["words"]) for r in rows}) == 3
    for r in rows:
        assert (r["score"] is None) == (r["rule"] is not None) == (r["words"] is None)
