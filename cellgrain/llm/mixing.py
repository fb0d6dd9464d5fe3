"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are summed by membership pattern (the
sorted set of their sources); a pattern of ``size`` words offers ``size`` words a time,
each further time at a higher price (convex repetition costs), up to ``repeats`` times.
A min-cost flow sends pattern capacity to the sources' quotas, so that quotas are met with
as little repetition as can be, and a document that two sources share is spent where it is
needed. A pattern's flow then becomes documents: all of them as often as it goes in whole,
and once more those of least seeded hash whose words fill the rest.

The seeded choice is made without a global order: sizes are summed in ranges of the hash, the running sums of
these few rows find the range in which a pattern's quota ends, and that range is divided in turn until
it holds ``FEW`` rows or one value of the hash. Rows that share that value (rows that repeat) go in as many as
fill the quota best; they are numbered by partition, so that no group of them meets in one task.

Sizes of the collected tables: one row a pattern and one a source. ``n`` sources have at most 2^n patterns; beyond
``MOST_PATTERNS`` of them ``plan`` raises. Flow problems fall apart by connected patterns and sources.

Defined results: a null text has size 0; documents of size 0 or without a source that has a
target take part as their source says (nothing to take); a null source is a source of its
own, the last; repeated rows count each; an empty table gives an empty result; other
columns pass untouched in ``mix`` and aren't read in ``taken``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 11
#: Bits of the hash that tell ranges apart in one pass, and the rows of a range that are looked at one by one.
BITS, FEW = 12, 20_000
#: Plans of so many patterns (about 100 bytes each) are broadcast; larger ones are joined by shuffles.
BROADCAST = 20_000
MOST_PATTERNS = 1_000_000


def sized(rows: DataFrame) -> DataFrame:
    """``rows`` with their column ``text`` replaced by ``size``: its number of runs of characters other than blank and U+0009 to U+000D, 0 for null."""
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            size = pc.count_substring_regex(text, r"[^\x20\x09-\x0D]+").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size], names=[*kept, "size"])

    return rows.mapInArrow(count, T.StructType([*rows.schema.fields[:-1], T.StructField("size", T.LongType())]))


def quotas(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = REPEATS) -> dict:
    """Target of each source: the weighted part of ``share`` of all sizes, none above ``most`` times its own size.

    Sources stand by code point, null last, and bear the weights in turn. What a source
    can't take is shared again by weight among the others.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in names if s in open_)
        above = [s for s in names if s in open_ and rest * weight[s] / total > most * sizes[s]]
        if not above:
            return target | {s: rest * weight[s] / total for s in names if s in open_}
        for s in above:
            target[s] = float(most * sizes[s])
            open_.remove(s)
        rest -= sum(target[s] for s in above)
    return target


def flow(capacity: dict[tuple, int], quota: dict, repeats: int = REPEATS) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources: a min-cost flow that meets the quotas as far as can be.

    The k-th time that a pattern's words are used costs 2k - 1 a word. Successive shortest
    paths with potentials, for each connected group of patterns and sources.
    """
    sent: dict[tuple, dict] = {p: {} for p in capacity}
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pattern in capacity:
        for s in pattern:
            parent[find(("s", s))] = find(("p", pattern))
    groups = defaultdict(list)
    for pattern in capacity:
        if pattern:
            groups[find(("p", pattern))].append(pattern)
    for patterns in groups.values():
        for pattern, source, amount in _flow({p: capacity[p] for p in patterns}, quota, repeats):
            sent[pattern][source] = amount
    return sent


def _flow(capacity: dict[tuple, int], quota: dict, repeats: int):
    arcs: list[list] = []  # to, capacity left, cost; the reverse arc is the next or previous one
    out = defaultdict(list)

    def arc(a, b, room, cost):
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    use = {}
    for p, size in sorted(capacity.items(), key=str):
        for k in range(1, repeats + 1):
            arc("from", ("p", p), size, 2 * k - 1)
        for s in p:
            use[p, s] = arc(("p", p), ("s", s), repeats * size, 0)
    for s in sorted({s for p in capacity for s in p}, key=str):
        arc(("s", s), "to", int(round(quota.get(s, 0))), 0)
    height = defaultdict(int)
    while True:
        far, came, heap = {"from": 0}, {}, [(0, 0, "from")]
        tick = 0
        while heap:
            d, _, at = heapq.heappop(heap)
            if d > far[at]:
                continue
            for i in out[at]:
                to, room, cost = arcs[i]
                if room > 0 and (new := d + cost + height[at] - height[to]) < far.get(to, float("inf")):
                    far[to], came[to] = new, i
                    heapq.heappush(heap, (new, tick := tick + 1, to))
        if "to" not in far:
            break
        reach = far["to"]
        for x, d in far.items():
            height[x] += min(d, reach)
        for x in out:
            if x not in far:
                height[x] += reach
        path, at = [], "to"
        while at != "from":
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push
    for (p, s), i in use.items():
        if arcs[i ^ 1][1]:
            yield p, s, arcs[i ^ 1][1]


def _drawn(docs: DataFrame, seed: int, id_col: str, text_col: str, sources: Column | None) -> list[Column]:
    """Columns that say where a row stands in the draw; equal rows stand alike."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sources = F.array_sort(F.array_distinct(F.array("source") if sources is None else sources))
    pattern = F.md5(F.coalesce(F.to_json(F.struct(sources.alias("s")), {"ignoreNullFields": "false"}), F.lit("")))
    return [sources.alias("sources"), pattern.alias("pattern"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("draw")]


def _range(shift: int) -> Column:
    """The bits of the draw above ``shift``, in its order."""
    return F.shiftright("draw", shift)


def _ends(drawn: DataFrame, rests: DataFrame, patterns: int, small) -> DataFrame:
    """For patterns with a rest to fill: cut, the value of the draw at which it ends, here, the rows of that value that go in, and equal, all of them.

    All rows below the cut go in. ``rests`` has pattern and rest; of a rest that not one row fits, here is 0.
    """
    shift, open_ = 64 - BITS, rests.where("rest > 0").select("pattern", "rest", F.lit(0).cast("long").alias("before"))
    at = drawn.withColumn("range", _range(shift)).join(small(open_), "pattern")
    while True:
        sums = at.groupBy("pattern", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.min("rest").alias("rest"), F.min("before").alias("before"))
        # At most 2^BITS ranges a pattern, or FEW values.
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("range"))
        ends = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        ends = checkpoint(ends.select("pattern", "range", "rest", (F.col("upto") - F.col("words")).alias("before"), "words", "rows"), patterns)
        if shift == 0:
            each = F.col("words") / F.col("rows")  # rows of one value are equal
            here = F.least("rows", F.round((F.col("rest") - F.col("before")) / each).cast("long"))
            return ends.select("pattern", F.col("range").alias("cut"), here.alias("here"), F.col("rows").alias("equal"))
        last, shift = shift, 0 if (ends.agg(F.max("rows")).first()[0] or 0) <= FEW else max(0, shift - BITS)
        inside = ends.select(F.col("pattern").alias("of"), F.col("range").alias("within"), "rest", "before")
        at = drawn.join(small(inside), (F.col("pattern") == F.col("of")) & (_range(last) == F.col("within"))).withColumn("range", _range(shift))


def plan(drawn: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """A row for each pattern: whole times, and cut, here and equal of the documents that go in once more (null: none).

    ``drawn`` has sources, pattern, draw and size; it is read several times.
    """
    import pyarrow as pa

    totals = drawn.groupBy("pattern").agg(F.sum("size").alias("words"), F.first("sources").alias("sources"))
    patterns = totals.limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity = {tuple(r["sources"]): r["words"] for r in patterns}
    sizes: dict = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    target = quotas(sizes, weights, share, repeats)
    sent = flow(capacity, target, repeats)
    rows = []
    for r in patterns:
        p, n = tuple(r["sources"]), r["words"]
        amount = sum(sent[p].values())
        first = p[0] if p else None
        whole = min(repeats, amount // n) if n else 0
        rows.append((r["pattern"], int(whole), int(amount - whole * n) if whole < repeats else 0, int(sizes.get(first, 0)), float(target.get(first, 0.0))))
    names, kinds = ("pattern", "whole", "rest", "source_size", "target"), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
    rows = drawn.sparkSession.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))}))
    small = F.broadcast if len(patterns) <= BROADCAST else lambda df: df
    out = rows.join(_ends(drawn, rows, len(patterns), small), "pattern", "left")
    return small(checkpoint(out.select("pattern", "whole", "source_size", "target", "cut", "here", "equal"), len(patterns)))


def _with_times(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows``, which have pattern and draw, with how often each is taken."""
    out = rows.join(planned, "pattern")
    some = F.when(F.col("draw") < F.col("cut"), 1).when((F.col("draw") == F.col("cut")) & (F.col("here") >= F.col("equal")), 1).otherwise(0)
    if planned.where("here > 0 and here < equal").isEmpty():
        return out.withColumn("times", F.col("whole") + some)
    in_part = F.coalesce((F.col("draw") == F.col("cut")) & (F.col("here") > 0) & (F.col("here") < F.col("equal")), F.lit(False))
    # Rows of one value: the first ``here`` of them, in the order of partitions.
    equal = checkpoint(out.where(in_part)).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    before = equal.groupBy("pattern", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("pattern", "__part", (F.sum("n").over(Window.partitionBy("pattern").orderBy("__part")) - F.col("n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("pattern", "__part").orderBy("__at"))
    equal = equal.withColumn("__nth", nth).join(before, ["pattern", "__part"])
    equal = equal.withColumn("times", F.col("whole") + (F.col("__before") + F.col("__nth") <= F.col("here")).cast("int"))
    return out.where(~in_part).withColumn("times", F.col("whole") + some).unionByName(equal.drop("__part", "__at", "__nth", "__before"))


def taken(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None) -> DataFrame:
    """doc_id, sources, size, source_size, target and times (how often the mix takes the document), a row for each document.

    ``sources``: an array column, by default the one ``source``. source_size and target are those of
    the first of them.
    """
    drawn = sized(docs.select(F.col(id_col).alias("doc_id"), *_drawn(docs, seed, id_col, text_col, sources), F.col(text_col).alias("text")))
    drawn = checkpoint(drawn)  # narrow rows, so that texts are read once
    out = _with_times(drawn, plan(drawn, weights, share, repeats))
    return out.select("doc_id", "sources", "size", "source_size", "target", "times")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns unchanged."""
    at = _drawn(docs, seed, id_col, text_col, sources)
    drawn = checkpoint(sized(docs.select(*at, F.col(text_col).alias("text"))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _with_times(docs.select(row, *at[1:]), plan(drawn, weights, share, repeats))
    return out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("row.*")
