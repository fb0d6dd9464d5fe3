"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of shingles of five words (runs of characters other than blank and U+0009 to
U+000D, A-Z lower-cased; a text of one to four words is one shingle). Links are pairs of
documents with a Jaccard similarity of at least 4/5.

1. Texts equal word for word fold into one representative, whose number of copies weighs in counts.
2. Representatives that agree in one of ``BANDS`` bands of MinHash values are candidates;
   components of candidates are clusters. At a similarity of 0.8 all bands miss with probability 6e-5.
3. A cluster falls into blocks of about ``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles. Each text is sent once, to its
   block. There the pairs of the block are compared: those that share a band compare their MinHash values ``STEP`` at a
   time, and are dropped once the posterior probability (uniform prior) that their similarity reaches
   the threshold falls below ``TOLERANCE``; for the rest the sets of shingles themselves (64-bit
   hashes) are intersected. The decision is exact integer arithmetic.
4. In clusters of several blocks each text goes on as what sets it off from its block's smallest text: the shingles and
   MinHash values that differ, a small part of the text for near copies. These rows meet in units, pairs of groups
   of blocks; a cluster of n texts has about n / ``_width(n)`` groups, so the pairs are dealt over many
   tasks and no text is sent more often than there are groups. Pairs of different blocks are compared as above.
5. A block or unit returns one row for each of its texts: the number of links it found, and the least
   text of its component there. Pairs are never written out; components over these rows are the classes.

Defined results: a null text counts as empty; empty texts equal each other and nothing else; a text
equal to another is linked to it whatever its length; a class bears the least id in it, null ids
only where there are no others; repeated rows are copies; an empty table gives an empty
result; other columns aren't read by ``join`` and pass untouched in ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, ascii_lower, checkpoint, give_back
from .components import components

WORDS = 5
THRESHOLD = (4, 5)
BANDS, ROWS, STEP = 32, 6, 16
TOLERANCE = 1e-6
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Most texts and shingles of a group of blocks.
WIDEST, WIDEST_SHINGLES = 4096, 1_000_000
#: Texts are sketched in stretches of about so many bytes.
STRETCH = 4_000_000


class Sketch:
    """Shingle hashes, MinHash values and band keys of texts, by NumPy over stretches of texts."""

    def __init__(self):
        import numpy as np

        draw = np.random.default_rng(20240229)
        self.flip = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
        self.times = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
        self.word = draw.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
        self.row = draw.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
        self.band = draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    @staticmethod
    def _mix(x):
        import numpy as np

        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x

    def shingles(self, split: list[list[bytes]]):
        """Hashes of all shingles of the texts' words, text after text, and the number for each text."""
        import numpy as np
        import pyarrow as pa
        import xxhash

        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
        own = np.fromiter(map(xxhash.xxh64_intdigest, flat.dictionary.to_pylist()), dtype=np.uint64, count=len(flat.dictionary))
        codes = flat.indices.to_numpy()
        # Zeros stand for the words that a short text lacks.
        words = np.concatenate([own[codes] if len(codes) else np.empty(0, dtype=np.uint64), np.zeros(WORDS, dtype=np.uint64)])
        count = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
        begin = np.cumsum(sizes) - sizes
        at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        short = np.repeat(np.where(sizes < WORDS, sizes, WORDS), count)
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(WORDS):
            part = words[at + k] * self.word[k]
            if (short <= k).any():
                part[short <= k] = np.uint64(k)
            out += part
            out = self._mix(out) if k == WORDS - 1 else out ^ (out >> np.uint64(29))
        return out, count

    def values(self, hashes, count):
        """MinHash values, a row for each text that has shingles (others: the largest value)."""
        import numpy as np

        out = np.full((len(count), BANDS * ROWS), np.iinfo(np.uint32).max, dtype=np.uint32)
        some = np.flatnonzero(count)
        if not len(some):
            return out
        narrow = (hashes >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(count[some])
        # Pieces of texts of about 50 000 shingles stay in the processor's cache.
        cuts = np.flatnonzero(np.diff((ends - 1) // 50_000, prepend=-1))
        for first, last in zip(cuts, [*cuts[1:], len(some)]):
            begin = ends[first] - count[some[first]]
            own = narrow[begin : ends[last - 1]]
            starts = (ends[first:last] - count[some[first:last]]) - begin
            room = np.empty_like(own)
            for k in range(BANDS * ROWS):
                np.bitwise_xor(own, self.flip[k], out=room)
                np.multiply(room, self.times[k], out=room)
                out[some[first:last], k] = np.minimum.reduceat(room, starts)
        return out

    def bands(self, values):
        import numpy as np

        grouped = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
        key = np.repeat(self.band[None, :], len(values), axis=0)
        for k in range(ROWS):
            key = self._mix(key + (grouped[:, :, k] + np.uint64(1)) * self.row[k])
        return key.view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _key(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def text_key(text: Column) -> Column:
    """What ``_key`` makes of a text, in SQL functions."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+", " "))))


def _sketches(batches) -> Iterator:
    """raw (Spark's xxhash64 of the text), key, shingles and bands for batches of (id, text)."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    sketch = Sketch()
    for batch in batches:
        texts, n = batch.column(1), batch.num_rows
        first = 0
        while first < n:
            split, raw, size, last = [], [], 0, first
            while last < n and size < STRETCH:
                text = (texts[last].as_py() or "").encode()
                size += len(text)
                raw.append(xxhash.xxh64_intdigest(text, seed=42))
                split.append(text.lower().split())
                last += 1
            hashes, count = sketch.shingles(split)
            keys = sketch.bands(sketch.values(hashes, count))
            ends = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).slice(first, last - first),
                "raw": pa.array(np.array(raw, dtype=np.uint64).view(np.int64)),
                "key": pa.array([_key(w) for w in split], pa.binary()),
                "shingles": pa.array(count),
                "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[count > 0].ravel())),
            })
            first = last
    give_back()


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """At each n, the least number of equal values among n with which a pair stays.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the probability
    that it is at least t is that of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in range(BANDS * ROWS + 1):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _survivors(values, bands, rows, cols, alive, least):
    """``alive`` [rows x cols] without the pairs that share no band or don't outlast the comparison of all values."""
    import numpy as np

    left, right = values[rows], values[cols]
    banded = np.zeros_like(alive)
    for k in range(BANDS):
        banded |= bands[rows, k][:, None] == bands[cols, k][None, :]
    alive &= banded
    small = left.shape[0] * right.shape[0] <= 4096
    same = np.zeros(alive.shape, dtype=np.uint8)
    for n in range(0, BANDS * ROWS, STEP):
        if not alive.any():
            break
        if small:
            same += (left[:, None, n : n + STEP] == right[None, :, n : n + STEP]).sum(axis=2, dtype=np.uint8)
        else:
            for k in range(n, n + STEP):
                same += left[:, k][:, None] == right[:, k][None, :]
        alive &= same >= least[min(n + STEP, BANDS * ROWS)]
    return alive


class _Sets:
    """Sorted sets of shingle hashes that are intersected many at once."""

    def __init__(self, sets):
        import numpy as np

        self.sets, self.sizes = sets, np.array([len(s) for s in sets], dtype=np.int64)
        self.owner = None

    def _lay(self) -> None:
        """Shingles that several sets have, as columns; owner and column of each occurrence, by column."""
        import numpy as np

        _, code, often = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        shared = often > 1
        self.columns = int(shared.sum())
        kept = shared[code]
        column = (np.cumsum(shared) - 1)[code[kept]]
        order = np.argsort(column, kind="stable")
        self.owner, self.column = np.repeat(np.arange(len(self.sets)), self.sizes)[kept][order], column[order]

    def linked(self, rows, cols, alive):
        """Mask of the pairs in ``alive`` whose sets have a Jaccard similarity of at least the threshold."""
        import numpy as np

        over, under = THRESHOLD
        p, q = np.nonzero(alive)
        out = np.zeros_like(alive)
        if not len(p):
            return out
        # inter / (a + b - inter) >= over / under
        need = over * (self.sizes[rows][p] + self.sizes[cols][q])
        one_by_one = 2e-5 * len(p) + 4e-8 * np.minimum(self.sizes[rows][p], self.sizes[cols][q]).sum()
        if self.owner is None and len(p) > 64 and one_by_one > 0.05:
            self._lay()
        # Estimates in seconds choose the way; both give the same numbers.
        if self.owner is None or one_by_one < 1e-10 * alive.size * self.columns:
            inter = np.zeros(len(p), dtype=np.int64)
            for i, (a, b) in enumerate(zip(rows[p], cols[q])):
                small, large = (self.sets[a], self.sets[b]) if self.sizes[a] < self.sizes[b] else (self.sets[b], self.sets[a])
                where = np.searchsorted(large, small)
                inter[i] = (large[np.minimum(where, len(large) - 1)] == small).sum()
        else:
            total, wide = np.zeros(alive.shape, dtype=np.float32), 2048
            for begin in range(0, self.columns, wide):
                lo, hi = np.searchsorted(self.column, [begin, begin + wide])
                has = np.zeros((len(self.sets), wide), dtype=np.float32)
                has[self.owner[lo:hi], self.column[lo:hi] - begin] = 1
                total += has[rows] @ has[cols].T
            inter = total[p, q].astype(np.int64)
        good = inter * (under + over) >= need
        out[p[good], q[good]] = True
        return out


#: Rows of the comparison that are worked on at once.
TILE = 256


def compare(least: list[int], keys: list[bytes], copies, values, bands, sets, rows, cols, apart_):
    """Links and components of the pairs of ``rows`` and ``cols``, of which ``apart_(rows, cols)`` says which count.

    Returns, for each text, links (copies included), linked texts, and the index of the least text (by key) of its component.
    """
    import numpy as np

    n = len(keys)
    every, weight = _Sets(sets), np.asarray(copies, dtype=np.int64)
    links, texts = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rank = np.empty(n, dtype=np.int64)
    by_key = np.array(sorted(range(n), key=keys.__getitem__), dtype=np.int64)
    rank[by_key] = np.arange(n)
    label = rank.copy()  # of each text, the least rank known in its component

    def root(x: int) -> int:
        while label[by_key[x]] != x:
            label[by_key[x]] = label[by_key[label[by_key[x]]]]
            x = label[by_key[x]]
        return x

    for begin in range(0, len(rows), TILE):
        some = rows[begin : begin + TILE]
        good = every.linked(some, cols, _survivors(values, bands, some, cols, apart_(some, cols), least))
        links[some] += good @ weight[cols]
        texts[some] += good.sum(axis=1)
        np.add.at(links, cols, weight[some] @ good)
        np.add.at(texts, cols, good.sum(axis=0))
        for i in np.flatnonzero(good.any(axis=1)):
            a = root(rank[some[i]])
            # Most partners bear the label already; only others are united.
            near = cols[good[i]]
            for b in np.unique(label[near]):
                b = root(b)
                if a != b:
                    a, high = min(a, b), max(a, b)
                    label[by_key[high]] = a
            label[near] = np.minimum(label[near], a)
    return links, texts, np.array([by_key[root(x)] for x in rank], dtype=np.int64)


def _found(keys: list[bytes], result) -> dict:
    links, texts, root = result
    some = [i for i in range(len(keys)) if links[i] or root[i] != i]
    return {"key": [keys[i] for i in some], "root": [keys[root[i]] for i in some], "links": links[some], "texts": texts[some]}


def _delta(own, hub) -> bytes:
    """A sorted set as a bit for each element of ``hub`` and the elements that are not in it."""
    import numpy as np

    if not len(hub):
        return own.tobytes()
    where = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
    inside = hub[where] == own
    bits = np.zeros(len(hub), dtype=bool)
    bits[where[inside]] = True
    return np.packbits(bits).tobytes() + own[~inside].tobytes()


def _undelta(data: bytes, hub):
    import numpy as np

    bits = (len(hub) + 7) // 8
    there = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=bits), count=len(hub)).astype(bool)
    return np.sort(np.concatenate([hub[there], np.frombuffer(data, dtype=np.uint64, offset=bits)]))


def _groups(batches, width: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows (as lists) that agree in their first ``width`` columns; such rows stand together."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            if tuple(row[:width]) != now:
                if rows:
                    yield now, rows
                now, rows = tuple(row[:width]), []
            rows.append(row[width:])
    if rows:
        yield now, rows


BLOCK_SCHEMA = "key binary, root binary, links bigint, texts bigint, cluster bigint, block int, blocks int, groups int, place int, copies bigint, set binary, minhash binary"


def _blocks(batches) -> Iterator:
    """Rows of a block stand together, by key. Returns what the block finds and, of a cluster of several blocks, its texts as differences from the smallest."""
    import numpy as np
    import pyarrow as pa

    names = ("key", "root", "links", "texts", "cluster", "block", "blocks", "groups", "place", "copies", "set", "minhash")
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.binary(), pa.binary())
    sketch, least = Sketch(), least_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    for (cluster, block), rows in _groups(batches, 2):
        own = list({key: (key, blocks, groups, copies, text) for blocks, groups, key, copies, text in rows}.values())  # rows that repeat come once
        rows.clear()
        keys, blocks, groups = [r[0] for r in own], own[0][1], own[0][2]
        hashes, count = sketch.shingles([_words(r[4]) for r in own])
        values = sketch.values(hashes, count)
        ends = np.cumsum(count)
        sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends, count)]
        copies, at = [r[3] for r in own], np.arange(len(own))
        del own, hashes
        out = dict.fromkeys(names, ())
        if len(keys) > 1:
            out |= _found(keys, compare(least, keys, copies, values, sketch.bands(values), sets, at, at, lambda rows, cols: rows[:, None] < cols[None, :]))
        n = len(out["key"])
        if n:
            yield pa.RecordBatch.from_pydict({c: pa.array(out[c], t) if len(out[c]) else pa.nulls(n, t) for c, t in zip(names, kinds)})
        if blocks > 1:
            none, m, hub = np.empty(0, dtype=np.uint64), len(keys), int(np.argmin(count))
            moved = {
                "key": keys, "cluster": [cluster] * m, "block": [block] * m, "blocks": [blocks] * m, "groups": [groups] * m, "place": [int(i != hub) for i in at], "copies": copies,
                "set": [_delta(s, none if i == hub else sets[hub]) for i, s in enumerate(sets)],
                "minhash": [v.tobytes() if i == hub else np.packbits(differ := v != values[hub]).tobytes() + v[differ].tobytes() for i, v in enumerate(values)],
            }
            yield pa.RecordBatch.from_pydict({c: pa.array(moved[c], t) if c in moved else pa.nulls(m, t) for c, t in zip(names, kinds)})
    give_back()


def _units(batches) -> Iterator:
    """Rows of a unit stand together, by block and place, so that the text of a block that the others are told by goes first."""
    import numpy as np
    import pyarrow as pa

    sketch, least = Sketch(), least_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    width = BANDS * ROWS
    for (_, first, second), rows in _groups(batches, 3):
        keys, copies, sets, block, group = [], [], [], [], []
        values = np.empty((len(rows), width), dtype=np.uint32)
        for own_group, own_block, place, key, own_copies, own_set, minhash in rows:
            at = len(keys)
            if place == 0:
                sets.append(np.frombuffer(own_set, dtype=np.uint64))
                values[at] = np.frombuffer(minhash, dtype=np.uint32)
                hub = sets[-1], at
            else:
                sets.append(_undelta(own_set, hub[0]))
                values[at] = values[hub[1]]
                differ = np.unpackbits(np.frombuffer(minhash, dtype=np.uint8, count=width // 8)).astype(bool)
                values[at, differ] = np.frombuffer(minhash, dtype=np.uint32, offset=width // 8)
            keys.append(key), copies.append(own_copies), block.append(own_block), group.append(own_group)
        rows.clear()
        block, group = np.array(block), np.array(group)
        left, right = np.flatnonzero(group == first), np.flatnonzero(group == second)
        if first == second:
            result = compare(least, keys, copies, values, sketch.bands(values), sets, left, right, lambda rows, cols: block[rows][:, None] < block[cols][None, :])
        else:
            result = compare(least, keys, copies, values, sketch.bands(values), sets, left, right, lambda rows, cols: np.ones((len(rows), len(cols)), dtype=bool))
        out = _found(keys, result)
        yield pa.RecordBatch.from_pydict({c: pa.array(out[c], t) for c, t in (("key", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("texts", pa.int64()))})
    give_back()


def _width(n: Column) -> Column:
    """Texts of a group of blocks: the more, the larger the cluster is, so that a text isn't sent n / BLOCK times; bounded by what a task may hold."""
    return F.least(F.lit(float(WIDEST)), F.greatest(F.lit(float(BLOCK)), F.sqrt(n * F.lit(128.0))))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id, n_links, n_copies, n_linked_texts.

    class_id is the least id of the documents linked by any chain. n_links counts the other documents with a
    similarity of at least 0.8, copies included; n_copies those equal word for word, itself included;
    n_linked_texts the different texts linked to.
    """
    return _classes(docs, id_col, text_col).drop("raw", "least")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    sketched = checkpoint(texts.mapInArrow(_sketches, f"doc_id {id_type}, raw bigint, key binary, shingles bigint, bands array<bigint>"))
    # A representative is known by its id and the hash of its raw text: ids that are null or borne by several rows must not pair each with each.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("rep")
    reps = sketched.groupBy("key").agg(rep, F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    reps = checkpoint(reps.withColumn("node", F.xxhash64("key")))  # where two keys meet in one node, a cluster is larger than need be

    banded = reps.select("node", F.explode("bands").alias("group"))
    shared = banded.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    clusters = components(banded.join(shared, "group"))
    members = checkpoint(reps.drop("bands").join(clusters, "node").withColumnRenamed("label", "cluster"), clusters.count())
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("all"))
    groups = F.greatest(F.ceil(F.col("n") / _width(F.col("n"))), F.ceil(F.col("all") / WIDEST_SHINGLES)).cast("int")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES), groups).cast("int")
    large = sizes.select("cluster", blocks.alias("blocks"), groups.alias("groups")).where("blocks > 1")
    members = members.withColumn("at", apart("cluster")).join(large.select(apart("cluster").alias("at"), "blocks", "groups"), "at", "left")
    one = F.lit(1)
    members = members.select("key", "rep", "copies", "cluster", F.coalesce("blocks", one).alias("blocks"), F.coalesce("groups", one).alias("groups"))
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    own = texts.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    at = members.join(own, (F.col("rep.raw") == F.col("raw")) & F.col("rep.doc_id").eqNullSafe(F.col("doc_id")))
    at = at.select("cluster", "block", "blocks", "groups", "key", "copies", "text").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "key")
    compared = checkpoint(at.mapInArrow(_blocks, BLOCK_SCHEMA))
    found = compared.where("root is not null").select("key", "root", "links", "texts")
    moved = compared.where("root is null").withColumn("group", F.expr("block % groups"))
    # A group of one block has no pairs of its own that its block hasn't compared.
    moved = moved.withColumn("other", F.explode(F.expr("filter(sequence(0, groups - 1), o -> o <> group or blocks > groups)")))
    moved = moved.select("cluster", F.least("group", "other").alias("a"), F.greatest("group", "other").alias("b"), "group", "block", "place", "key", "copies", "set", "minhash")
    moved = moved.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "block", "place", "key")
    found = checkpoint(found.union(moved.mapInArrow(_units, "key binary, root binary, links bigint, texts bigint")))

    links = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    labels = components(found.select(F.col("key").alias("node"), F.col("root").alias("group")).union(found.select("root", "root")))
    of_key = reps.select("key", "rep").join(labels.withColumnRenamed("node", "key"), "key")
    least = of_key.groupBy("label").agg(F.min("rep").alias("least"))
    of_key = of_key.select("key", apart("label").alias("at")).join(least.select(apart("label").alias("at"), "least"), "at").drop("at").join(links, "key", "left")
    by_key = reps.select("key", "rep", "copies").join(of_key, "key", "left")
    by_key = by_key.select(
        apart("key").alias("at"), F.coalesce("least", "rep").alias("least"), F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("texts", F.lit(0)).alias("n_linked_texts")
    )
    out = sketched.select("doc_id", "raw", apart("key").alias("at")).join(by_key, "at")
    return out.select("doc_id", F.col("least.doc_id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), "n_linked_texts", "raw", "least")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays for each class, that of the least id; all columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    stay = _classes(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("raw") == F.col("least.raw")))
    # Rows that repeat id and text are one document: one of them stays.
    stay = stay.groupBy(F.col("doc_id").alias("class_id"), F.col("raw").alias("class_raw")).agg(F.count(F.lit(1)).alias("bearers"))
    own = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("raw"))
    kept = own.join(stay, F.col("id").eqNullSafe(F.col("class_id")) & (F.col("raw") == F.col("class_raw")))
    nth = F.row_number().over(Window.partitionBy("id", "raw").orderBy(F.xxhash64("row")))
    once = kept.where("bearers = 1").select("row.*")
    return once.unionByName(kept.where("bearers > 1").withColumn("nth", nth).where("nth = 1").select("row.*"))
