import hashlib
import re
from collections import Counter

import corpus_pipeline
import __spark_entry__
from cellgrain.llm import queries

from .conftest import make
from .test_ngram_join import shingles


def test_stages(spark, sf_dir, tmp_path):
    """Each stage, written and read again, against brute force over its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert all(labels.get(d, 1) for d in gone) and len(gone) < 0.2 * len(before)
        elif name == "exact dedup":
            texts = {(r["text"] or "").lower() for r in before}
            assert len(after) == len({"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "") for r in before}) >= len(texts)
        elif name == "n-gram jaccard join":
            sets = [shingles(r["text"]) for r in after]
            assert not any(a and 5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
            for r in {x["doc_id"]: x for x in before}.values():
                if r["doc_id"] not in {x["doc_id"] for x in after}:
                    own = shingles(r["text"])
                    assert any(5 * len(own & shingles(x["text"])) >= 4 * len(own | shingles(x["text"])) for x in before if x["doc_id"] != r["doc_id"])
        elif name == "mixing sources":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
            size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
            assert abs(size(after) / size(before) - 1.5) < 0.05
        else:
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in after)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stages_on_edges(spark, sf_dir, edges):
    docs = edges
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_make_has_all_columns(spark):
    assert make(spark, [(1, "a")]).count() == 1
