"""Document fingerprints: one-permutation MinHash with optimal densification, b-bit packed.

Every shingle of five words is hashed once. The top bits of the hash name a bin, and a
bin holds its least hash. An empty bin borrows from a full one found by a probing order
that depends on the empty bin alone (optimal densification): first ``PROBES`` hashed
places, then the full bin whose hash with the empty one is least. A fingerprint packs the
lowest eight bits of each bin. Likeness is the share of equal bins, corrected for the
chance that unlike hashes agree in eight bits, and clipped to 0..1.

All of it is SQL functions over one row: sorted hashes give each bin's least one, and
nothing is exploded or shuffled to make a fingerprint. Words are runs of characters
other than blank and U+0009 to U+000D, case kept; a text of one to four words has one
shingle of all of them.

``with_next`` finds each document's successor by id without a global window: ids and
lengths alone are range-partitioned and laid out by partition, and only the last
row of each partition (one a partition) passes by the driver.

Defined results: a null text counts as empty; a text without words has the fingerprint of
``NOTHING``, like only to another such; null ids stand first in the order; rows that share an
id follow the id before it together, and the successor's text is then the least of
theirs; a sole document succeeds itself; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, let

BINS, BITS, PROBES, WORDS = 256, 8, 24, 5
SPACE = r"[\x20\x09-\x0D]+"
NOTHING = "0" * (BINS * BITS // 4)


def _mix(x: int) -> int:
    """A 64-bit mixing function for the constant probing tables."""
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    return x ^ x >> 31


def _constant(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # folds to one constant


def shingles(text: Column) -> Column:
    """Array of 64-bit hashes of the shingles of a text, in order."""

    def hashes(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
        few = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= WORDS, many).otherwise(few)

    return let(F.filter(F.split(text, SPACE), lambda w: w != ""), hashes)


def bins(hashes: Column) -> Column:
    """``BINS`` low-order values (tinyint) of the densified bins, or null where there are no hashes."""

    def bin_of(h: Column) -> Column:
        return (F.shiftright(h, 64 - BINS.bit_length() + 1) + F.lit(BINS // 2)).cast("int")

    def low(h: Column) -> Column:
        # The least hash of a bin is small in its high bits but free in its low ones.
        return (h.bitwiseAND(F.lit((1 << BITS) - 1)) - F.lit(1 << BITS - 1)).cast("tinyint")

    def from_sorted(ordered: Column) -> Column:
        first = F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))
        return let(first, from_first)

    def from_first(first: Column) -> Column:
        full = F.struct(F.transform(first, bin_of).alias("at"), F.transform(first, low).alias("low"))
        return let(full, from_full)

    def from_full(full: Column) -> Column:
        scattered = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(full["low"], F.array_position(full["at"], i).cast("int") - 1))
        # get() of -1, for a position that isn't found, is null
        return let(scattered, lambda sparse: F.when(F.size(full["at"]) == BINS, sparse).otherwise(densify(sparse, full)))

    def densify(sparse: Column, full: Column) -> Column:
        probes = [_constant(_mix(i * 1009 + k) % BINS for i in range(BINS)) for k in range(1, PROBES + 1)]

        def borrow(i: Column) -> Column:
            order = F.transform(full["at"], lambda j: F.struct(F.xxhash64(i, j).alias("h"), F.get(sparse, j).alias("low")))
            return F.coalesce(*[F.get(sparse, F.get(p, i)) for p in probes], F.array_min(order)["low"])

        return F.transform(sparse, lambda v, i: F.when(v.isNotNull(), v).otherwise(borrow(i)))

    return F.when(F.size(hashes) > 0, let(F.sort_array(hashes), from_sorted))


def low_bits(text: Column) -> Column:
    return let(shingles(text), bins)


def packed(values: Column) -> Column:
    """The bins' low-order bits as one hexadecimal string."""
    each = 64 // BITS

    def word(k: Column) -> Column:
        out = F.lit(0).cast("long")
        for j in range(each):
            byte = (F.get(values, k * each + j).cast("long") + F.lit(1 << BITS - 1)).bitwiseAND(F.lit((1 << BITS) - 1))
            out = F.shiftleft(out, BITS).bitwiseOR(byte)
        return F.lpad(F.hex(out), 64 // 4, "0")

    text = F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), word), ""))
    return F.when(values.isNull(), NOTHING).otherwise(text)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their bins."""
    chance = 1 / (1 << BITS)
    share = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - chance) / (1 - chance)))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), packed(low_bits(text)).alias("fingerprint"))


def _previous(ids: DataFrame) -> DataFrame:
    """For each id (key, doc_id, n) the id before it: key, doc_id, n as struct ``previous``; the first one's is the last."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpoint(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    own = F.struct("key", "n")
    ends = sorted((r["part"], r["last"]["key"], r["last"]["n"]) for r in laid.groupBy("part").agg(F.max_by(own, F.struct("doc_id")).alias("last")).collect())
    at = [e[0] for e in ends]
    before = [(p, *ends[bisect.bisect_left(at, p) - 1][1:]) for p in at]  # [-1], the last of all, for the first
    before = ids.sparkSession.createDataFrame(before, "part int, last_key string, last_n int")
    lag = F.lag(own).over(Window.partitionBy("part").orderBy("doc_id"))
    out = laid.withColumn("previous", lag).join(F.broadcast(before), "part")  # one row a partition
    return out.select("key", F.coalesce("previous", F.struct(F.col("last_key").alias("key"), F.col("last_n").alias("n"))).alias("previous"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat(F.when(F.col(id_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    plain = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"))
    ids = plain.groupBy("key", "doc_id").agg(F.max(F.length("text")).alias("n"))
    # Read twice, shuffled once: both readers find the same exchange.
    own = plain.withColumn("bits", low_bits(F.col("text"))).repartition("key")
    follower = own.groupBy("key").agg(F.min(F.struct("text", "bits", "doc_id")).alias("next")).join(_previous(ids), "key")
    half = F.floor(F.col("previous.n") / 2).cast("int")
    follower = follower.select(
        F.col("previous.key").alias("key"), F.col("next.doc_id").alias("next_id"), F.col("next.bits").alias("next_bits"),
        F.substring(F.col("next.text"), F.lit(1), half).alias("head"),
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("head"), F.lit(1), half))
    out = own.join(follower, "key").select("doc_id", "next_id", n.cast("long").alias("n_chars"), "bits", "next_bits", edited.alias("edited"))
    out = out.select("doc_id", "next_id", "n_chars", "bits", "next_bits", F.sha2("edited", 256).alias("edited_sha256"), low_bits(F.col("edited")).alias("edited_bits"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"), "next_id",
    )
