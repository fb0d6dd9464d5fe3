import hashlib
from collections import defaultdict

import duckdb
import pytest

from cellgrain.llm import exact_dedup

from .conftest import CLASHING, EDGES, make


def norm(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, keep):
    same = defaultdict(list)
    for i, t in rows:
        same[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in same[norm(t)] if x is not None]
        stays = (max if keep == "max" else min)(ids) if ids else None
        out.append((i, stays, len(same[norm(t)]), i == stays, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_groups_match_brute_force(edges, keep):
    got = [tuple(r) for r in exact_dedup.groups(edges, keep).collect()]
    assert sorted(got, key=str) == brute([r[:2] for r in EDGES], keep)


def test_empty_table(empty):
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


def test_deduplicate_keeps_one_row_and_all_columns(edges):
    out = exact_dedup.deduplicate(edges)
    assert out.columns == edges.columns and set(CLASHING) <= set(out.columns)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len({norm(t) for _, t in kept}) == len(kept) == len({norm(t) for _, t, *_ in EDGES})
    assert (4, "one") in kept and (5, "One") not in kept


def test_collided_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that is the same for all texts, groups are still those of equal texts."""
    from pyspark.sql import functions as F

    docs = make(spark, [(1, "a"), (2, "b"), (3, "A"), (4, None)])
    monkeypatch.setattr(exact_dedup, "_keyed", lambda d, i, t: d.select(d[i].alias("doc_id"), F.lower(F.coalesce(d[t], F.lit(""))).alias("norm")).withColumn("hash", F.lit("same")))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.groups(docs, "max").collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_oracle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(exact_dedup.ORACLE).fetchall())
    assert sorted(tuple(r) for r in exact_dedup.groups(docs, "max").collect()) == want
