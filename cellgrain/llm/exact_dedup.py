"""Exact deduplication by a 128-bit content hash, collisions excluded by comparing bytes.

Rows are grouped by the MD5 of their normalised text. Within a group the texts
themselves are compared: the aggregation gathers the *set* of texts under a hash, so
that copies fold together before the shuffle and a hot group costs one text for each
map task. A set of one text proves that the hash stands for this text alone. Hashes
that stand for several texts (none in practice) go through a second path that groups
by the text itself.

Defined results: a null text counts as empty; empty texts equal each other; a null
id is never kept while its group has another id; rows that repeat both id and text are
one document to ``groups`` (all of them bear ``kept``), while ``deduplicate``
returns one of them. An empty table gives an empty result. Columns of the input are
addressed by name only and those of other names (even ``_hash``) pass untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.select(docs[id_col].alias("doc_id"), text.alias("norm")).withColumn("hash", F.md5("norm"))


def _survivor(keep: str):
    return {"max": F.max, "min": F.min}[keep]("doc_id").alias("keep_id")


def groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest id of a group stays.
    """
    rows = _keyed(docs, id_col, text_col)
    by_hash = rows.groupBy("hash").agg(
        F.count(F.lit(1)).alias("group_size"), _survivor(keep), F.size(F.collect_set("norm")).alias("texts")
    )
    by_hash = checkpoint(by_hash)
    sha = F.sha2(F.col("norm"), 256).alias("text_sha256")
    single = by_hash.where("texts = 1").drop("texts")
    out = rows.select("doc_id", "hash", sha).join(single, "hash")
    collided = by_hash.where("texts > 1").select("hash")
    if not collided.isEmpty():
        several = rows.join(collided, "hash")
        by_text = several.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size"), _survivor(keep))
        out = out.unionByName(several.join(by_text, ["hash", "norm"]).select("doc_id", "hash", sha, "group_size", "keep_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns unchanged."""
    columns = docs.columns
    key = F.struct(
        F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256).alias("sha")
    )
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key.alias("key"))
    stay = groups(docs, keep, id_col, text_col).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    # Only ids that several kept rows bear need the tie broken; the count moves ids and hashes, no text.
    stay = stay.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    joined = own.join(stay, F.col("key.doc_id").eqNullSafe(F.col("id")) & (F.col("key.sha") == F.col("sha")))
    first = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.xxhash64("row")))
    once = joined.where("copies = 1").select("row.*")
    again = joined.where("copies > 1").withColumn("nth", first).where("nth = 1").select("row.*")
    return once.unionByName(again)


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
