import re
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from cellgrain.llm import mixing

from .conftest import make


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def docs(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 13 + 1)), ["a", "B", "é", None, "hot", "hot", "hot"][i % 7]) for i in range(2000)]
    return make(spark, rows + [(9000, None, "a"), (9001, " \t ", "zz"), (None, "no id", "a"), (5, "same id", "a")])


def test_sizes_targets_and_taken(spark):
    frame = docs(spark)
    rows = mixing.taken(frame).collect()
    assert len(rows) == frame.count()
    texts = defaultdict(list)
    for r in frame.collect():
        texts[r["doc_id"]].append(count(r["text"]))
    assert all(r["size"] in texts[r["doc_id"]] for r in rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        s = by[r["sources"][0]]
        s[0] += r["size"]
        s[1] += r["size"] * r["times"]
        s[2] = r["target"]
        assert 0 <= r["times"] <= 2
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.quotas({s: by[s][0] for s in by})
    weights = dict(zip(order, (3, 1, 2) * 9))
    assert sum(want.values()) == pytest.approx(1.5 * sum(v[0] for v in by.values()))
    free = [s for s in order if want[s] < 2 * by[s][0] - 1e-9]
    assert len({round(want[s] / weights[s], 6) for s in free}) == 1  # by weight, where no source is full
    for s in order:
        assert by[s][2] == pytest.approx(want[s])
        assert abs(by[s][1] - want[s]) <= 13, s  # within a document


def test_reruns_and_layouts_agree(spark):
    frame = docs(spark)
    a = sorted(map(str, mixing.taken(frame).select("doc_id", "size", "times").collect()))
    b = sorted(map(str, mixing.taken(frame.repartition(9, "text")).select("doc_id", "size", "times").collect()))
    assert a == b


def test_mix_repeats_rows(spark):
    frame = docs(spark)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert out.count() == mixing.taken(frame).agg(F.sum("times")).first()[0]


def test_empty(empty):
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_flow_is_cheapest():
    """Against trying all flows in steps of one on small networks with overlapping sources."""
    capacity = {("a",): 3, ("a", "b"): 2, ("b",): 1}
    for quota in ({"a": 4, "b": 4}, {"a": 6, "b": 2}, {"a": 1, "b": 5}, {"a": 9, "b": 9}):
        sent = mixing.flow(capacity, quota)
        got = {s: sum(v.get(s, 0) for v in sent.values()) for s in quota}
        cost = sum(min(sum(v.values()), capacity[p]) + 3 * max(0, sum(v.values()) - capacity[p]) for p, v in sent.items())
        best = max(
            (min(x1 + x2, quota["a"]) + min(y2 + y3, quota["b"]), -sum(min(n, c) + 3 * max(0, n - c) for n, c in ((x1, 3), (x2 + y2, 2), (y3, 1))))
            for x1, x2, y2, y3 in product(range(7), range(5), range(5), range(3))
            if x2 + y2 <= 4 and x1 + x2 <= quota["a"] and y2 + y3 <= quota["b"]
        )
        assert (sum(got.values()), -cost) == best
        assert all(got[s] <= quota[s] for s in quota) and all(sum(v.values()) <= 2 * capacity[p] for p, v in sent.items())


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, "x") for i in range(600)]
    frame = make(spark, rows).withColumn("of", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"))))
    got = mixing.taken(frame, weights=(1, 2), share=1.0, sources=F.col("of")).collect()
    # a: 4000 words it could offer alone or shared, target 2000; b: target 4000
    assert sum(r["times"] * r["size"] for r in got) == pytest.approx(1.0 * 8000, abs=20)


def test_repeated_rows_fill_a_quota_in_part(spark):
    """Rows equal in id and text share one place in the draw; as many of them go in as the target needs."""
    frame = make(spark, [(1, " ".join(["w"] * 10), "a")] * 900 + [(2, " ".join(["v"] * 10), "b")] * 100).repartition(7)
    rows = mixing.taken(frame).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r["sources"][0]][0] += r["size"] * r["times"]
        by[r["sources"][0]][1] = r["target"]
    assert len(rows) == 1000 and all(abs(got - target) <= 10 for got, target in by.values())
    assert mixing.mix(frame).count() == sum(r["times"] for r in rows)


def test_ranges_are_divided_until_few_rows_are_left(spark, monkeypatch):
    frame = docs(spark)
    want = sorted(map(str, mixing.taken(frame).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    monkeypatch.setattr(mixing, "BITS", 4)
    assert sorted(map(str, mixing.taken(frame).collect())) == want


def test_very_long_texts_and_odd_blanks(spark):
    texts = ["x " * 200_000, "a b c d", "\x1c\x1d e", "\t\n\v\f\r", "é è\n\nê", None]
    rows = mixing.taken(make(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: count(t) for i, t in enumerate(texts)}
