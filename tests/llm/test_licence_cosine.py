"""The licence scan held against a plain TF-IDF and cosine, and inheritance over the stand-in paths of the query."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellgrain.llm import licenses, queries

from .conftest import make


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain(texts):
    """(license, score) of each text taken as one unit, or None."""
    known = licenses.templates()
    bearing = {t for t in texts if re.search(licenses.TRIGGER, t)}
    n = len(known) + len({" ".join(words(t)) for t in bearing})
    df = Counter(w for _, t in known for w in set(words(t))) + Counter(w for t in {" ".join(words(t)) for t in bearing} for w in set(t.split()))

    def vector(text):
        tf = Counter(words(text))
        return {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in tf.items()}

    def cosine(a, b):
        return sum(v * b.get(w, 0.0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    out = []
    for t in texts:
        scored = [(-round(cosine(vector(t), vector(x)), 9), name) for name, x in known] if t in bearing else []
        best = min(scored, default=(0, None))
        out.append((best[1], -best[0]) if -best[0] >= licenses.THRESHOLD else (None, None))
    return out


TEXTS = [
    "Licensed under the MIT license.", "this file is licensed under the terms of the Apache License version 2", "Copyright and all rights reserved by us alone",
    "released into the public domain without any license", "GNU Lesser General Public License, version 2.1", "GNU General Public License version 2 or 3", "nothing here says so",
    "The licence of the driver was redistributed among officers of the town", "BSD 3-Clause New or Revised License", "MIT MIT MIT license license", "ISC license ISC license", "",
]


def test_scores_are_those_of_plain_vectors(spark):
    rows = licenses.scan(make(spark, [(i, t, f"d{i}/x") for i, t in enumerate(TEXTS)]), F.col("source")).collect()
    got = {r["doc_id"]: (r["license"], r["score"]) for r in rows}
    for i, want in enumerate(plain(TEXTS)):
        assert got[i][0] == want[0], (TEXTS[i], got[i], want)
        assert got[i][1] == (pytest.approx(want[1], abs=1e-6) if want[0] else None)
    assert sum(x[0] is not None for x in got.values()) >= 6


def test_ties_repeated_rows_and_very_long_texts(spark):
    """Ties go to the first by name; every row has its result; a text of very many lines is looked through."""
    tie = "Licensed under the license."
    scored = sorted((-round(x, 6), n) for n, x in [(r, s) for r, s in [plain([tie])[0]] if r])
    long = "\n".join(f"line {i} of prose without end" for i in range(40_000)) + "\nReleased under the ISC license."
    docs = make(spark, [(1, tie, "a/x"), (1, tie, "a/x"), (2, long, "b/x"), (3, long, "b/y")])
    rows = licenses.scan(docs, F.col("source")).collect()
    assert len(rows) == 4 and len({(r["license"], r["score"]) for r in rows if r["doc_id"] == 1}) == 1
    assert [r["license"] for r in rows if r["doc_id"] == 1][0] == (scored[0][1] if scored else None)
    assert {r["license"] for r in rows if r["doc_id"] > 1} == {"ISC"}


def test_query_has_all_origins(spark, tmp_path):
    """Documents inherit from the nearest licence file above them, as a plain walk up the paths finds it."""
    spark_rows = [(i, ("Prose of a kind.\nReleased under the MIT License." if i % 21 == 0 else "Some prose. All rights reserved." if i % 11 == 0 else f"Only prose {i}."), f"src{i % 3}") for i in range(900, 1400)]
    make(spark, spark_rows).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_licenses(spark, str(tmp_path)).collect()
    by_directory: dict = {}
    for r in rows:
        where, _, name = r["path"].rpartition("/")
        if name == "LICENSE" and r["origin"] == "file":
            best = by_directory.get(where)
            by_directory[where] = min(filter(None, (best, (-r["score"], r["license"]))))
    seen = Counter(r["origin"] for r in rows)
    assert seen["file"] and seen["header"] and seen["inherited"] and len(rows) == 500
    for r in rows:
        if r["origin"] in ("file", "header"):
            continue
        at, want = r["path"].rpartition("/")[0], None
        while want is None and at:
            want = by_directory.get(at)
            found, at = at, at.rpartition("/")[0]
        assert r["license"] == (want[1] if want else None) and r["origin"] == ("inherited" if want else None)
        assert r["origin_directory"] == (found if want else None)
