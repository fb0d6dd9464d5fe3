"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A text is split by the tokenizer's pattern and every distinct piece is encoded once
for a stretch of a partition. Encoding is a recursive query over rows of (piece, list of
tokens): each step unnests the token positions, joins neighbouring tokens with the merge
table, and contracts the leftmost pair of least rank in every piece until no pair is in
the table. Decoding joins token positions with the vocabulary and aggregates the bytes in
the order of positions.

A merge's rank is that of the merged bytes, as in rank files, so the merge table holds
each way to split a vocabulary entry into two entries. A vocabulary is *proper* if each entry, taken as a
piece, becomes itself by contractions of no higher rank than its own, as after any training. Then no
contraction makes a pair of its own rank or below: the bytes of such a pair have been set off from their
neighbours from the start, so contractions of lower rank would have made its entry before. The next pairs of
the least rank are thus those that were there, and one step may take all of them, from the left, with the
result of as many single steps. Pieces of more than ``LONG`` bytes are contracted that way, but only with a
vocabulary that ``proper`` has found to be so; with any other all pieces take single steps.

Memory: a batch is worked off in stretches of ``STRETCH`` pieces, the recursion takes new pieces in lots whose lists of
tokens, over all steps, have about ``LEARN`` entries, and the store of known pieces starts anew beyond ``STORE``
entries, so neither batch size, partition size nor the number of distinct pieces matters. These are only
buffers; results do not depend on them. A piece is one list, so what a task needs grows with the longest piece alone.

Defined results: a null text counts as empty and has no tokens; rows that repeat are
encoded each; other columns, of whatever name, are not read; an empty table gives an
empty result. Rows stay in their partition and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

LONG, STRETCH, STORE, LEARN = 100, 120_000, 300_000, 4_000_000
#: DuckDB's memory in MB, and bytes more for each byte of the longest piece.
MEMORY, MEMORY_A_BYTE = 256, 1000

#: One contraction a step in each piece. ``k`` packs the merged token and the position of its left part.
STEP = """
WITH RECURSIVE state(piece, tokens) AS (
    SELECT piece, tokens FROM fresh
    UNION ALL
    SELECT state.piece, tokens[:(k & 4294967295) - 1] || [(k >> 32)::INTEGER] || tokens[(k & 4294967295) + 2:]
    FROM state JOIN (
        SELECT pairs.piece, min((merges.id::BIGINT << 32) + pairs.position) AS k
        FROM (SELECT piece, unnest(list_zip(tokens[:-2], tokens[2:])) AS pair, generate_subscripts(tokens[2:], 1) AS position
              FROM state) AS pairs
        JOIN merges ON merges.pair = (pairs.pair[1]::BIGINT << 32) + pairs.pair[2]
        GROUP BY pairs.piece) AS best USING (piece))
SELECT piece, arg_min(tokens, len(tokens)) AS tokens FROM state GROUP BY piece ORDER BY piece
"""

#: All occurrences of the least rank a step; in a run of overlapping ones every second is taken, from the left. For proper vocabularies.
STEP_LONG = """
WITH RECURSIVE state(piece, tokens) USING KEY (piece) AS (
    SELECT piece, tokens FROM fresh
    UNION
    (WITH pairs AS (
        SELECT piece, unnest(list_zip(tokens[:-2], tokens[2:])) AS pair, generate_subscripts(tokens[2:], 1) AS position FROM state),
     ranked AS (
        SELECT piece, position, id, min(id) OVER (PARTITION BY piece) AS least
        FROM pairs JOIN merges ON merges.pair = (pairs.pair[1]::BIGINT << 32) + pairs.pair[2]),
     runs AS (
        SELECT piece, position, id, position - row_number() OVER (PARTITION BY piece ORDER BY position) AS run
        FROM ranked WHERE id = least),
     taken AS (
        SELECT piece, position, id FROM runs QUALIFY row_number() OVER (PARTITION BY piece, run ORDER BY position) % 2 = 1),
     places AS (SELECT piece, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS position FROM state)
     SELECT places.piece, list(coalesce(here.id, places.token) ORDER BY places.position)
     FROM places
     SEMI JOIN taken ON taken.piece = places.piece
     LEFT JOIN taken AS here ON here.piece = places.piece AND here.position = places.position
     LEFT JOIN taken AS left_of ON left_of.piece = places.piece AND left_of.position = places.position - 1
     WHERE left_of.id IS NULL
     GROUP BY places.piece))
SELECT piece, tokens FROM state ORDER BY piece
"""

#: Entries that don't become themselves, or by a rank above their own.
IMPROPER = """
WITH RECURSIVE state(piece, tokens, top) AS (
    SELECT piece, tokens, -1::BIGINT FROM fresh
    UNION ALL
    SELECT state.piece, tokens[:(k & 4294967295) - 1] || [(k >> 32)::INTEGER] || tokens[(k & 4294967295) + 2:], greatest(top, k >> 32)
    FROM state JOIN (
        SELECT pairs.piece, min((merges.id::BIGINT << 32) + pairs.position) AS k
        FROM (SELECT piece, unnest(list_zip(tokens[:-2], tokens[2:])) AS pair, generate_subscripts(tokens[2:], 1) AS position
              FROM state) AS pairs
        JOIN merges ON merges.pair = (pairs.pair[1]::BIGINT << 32) + pairs.pair[2]
        GROUP BY pairs.piece) AS best USING (piece))
SELECT count(*) FROM (SELECT piece, min(len(tokens)) AS left_over, max(top) AS top FROM state GROUP BY piece)
JOIN entries USING (piece) WHERE left_over > 1 OR top > entries.id
"""

DECODE = """
SELECT stretch.doc, string_agg(vocabulary.bytes, '' ORDER BY stretch.position) AS bytes
FROM stretch JOIN vocabulary USING (id) GROUP BY stretch.doc ORDER BY stretch.doc
"""


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks in the bytes of a rank file: base64 of the token, blank, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


#: Tables of the last vocabulary that a Python worker used, a few MB.
_TABLES: dict[bytes, tuple] = {}


def tables(ranks: dict[bytes, int]):
    """Ids of single bytes, the merge table (packed pair, id), the vocabulary (id, bytes in hexadecimal) of ranks."""
    import numpy as np
    import pyarrow as pa

    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                left.append(a), right.append(b), merged.append(rank)
    left, right, merged = (np.array(x, dtype=np.int64) for x in (left, right, merged))
    merges = pa.table({"pair": pa.array((left << 32) + right), "id": pa.array(merged.astype(np.int32))})
    vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([token.hex() for token in ranks])})
    return np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32), merges, vocabulary


class Codec:
    """Encoder and decoder of one task; holds a DuckDB connection of its own until it is closed."""

    def __init__(self, lines: bytes, pattern: str, proper: bool | None = None):
        import duckdb
        import regex

        # The pattern's \s is Unicode's White_Space; that of the regex module also holds U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        key = hashlib.sha256(lines).digest()
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = tables(read_ranks(lines))
        self.first, merges, vocabulary = _TABLES[key]
        self._table("merges", merges)
        self._table("vocabulary", vocabulary)
        self.forget()
        self.proper = self._proper() if proper is None else proper

    def close(self) -> None:
        """Give the memory back: a Python worker lives on and serves other tasks."""
        self.forget()
        self.db.close()
        give_back()

    def _table(self, name: str, rows) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def forget(self) -> None:
        import numpy as np

        self.index: dict[str, int] = {}
        self.flat, self.start, self.count = (np.empty(0, dtype=t) for t in (np.int32, np.int64, np.int64))

    def _proper(self) -> bool:
        """Whether each entry of several bytes comes from single bytes by contractions of no higher rank."""
        import pyarrow as pa

        entries = [(i, bytes.fromhex(text)) for i, text in self.db.execute("SELECT id, bytes FROM vocabulary").fetchall()]
        for begin in range(0, len(entries), 20_000):
            some = entries[begin : begin + 20_000]
            self.db.register("fresh", pa.table({"piece": pa.array(range(len(some)), pa.int64()), "tokens": pa.array([self.first[list(b)] for _, b in some], pa.list_(pa.int32()))}))
            self.db.register("entries", pa.table({"piece": pa.array(range(len(some)), pa.int64()), "id": pa.array([i for i, _ in some], pa.int64())}))
            wrong = self.db.execute(IMPROPER).fetchall()[0][0]
            self.db.unregister("fresh"), self.db.unregister("entries")
            if wrong:
                return False
        return True

    def _fixpoint(self, pieces: list[bytes], step: str):
        """Tokens of distinct pieces: flat array and the number for each."""
        import numpy as np
        import pyarrow as pa

        if not pieces:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]))
        self.db.register("fresh", pa.table({"piece": pa.array(np.arange(len(pieces))), "tokens": tokens}))
        out = self.db.sql(step).to_arrow_table().column("tokens").combine_chunks()
        self.db.unregister("fresh")
        return out.flatten().to_numpy(), out.value_lengths().to_numpy().astype(np.int64)

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        raw = [p.encode() for p in pieces]
        lots: list[tuple[list[int], str]] = []
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        at_once = (sizes > LONG) & self.proper
        # Single steps keep the lists of all steps, half the square of a piece's bytes; the others the last one.
        for step, own, entries in ((STEP, np.flatnonzero(~at_once), sizes * sizes // 2), (STEP_LONG, np.flatnonzero(at_once), 16 * sizes)):
            lot = np.cumsum(entries[own]) // LEARN
            cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1), len(own)] if len(own) else []
            lots += [(own[x:y].tolist(), step) for x, y in zip(cuts, cuts[1:])]
        if len(sizes):
            self.db.execute(f"SET memory_limit = '{MEMORY + int(sizes.max()) * MEMORY_A_BYTE // 1_000_000}MB'")
        for at, step in lots:
            some = [pieces[i] for i in at]
            flat, count = self._fixpoint([raw[i] for i in at], step)
            self.index.update(zip(some, range(len(self.count), len(self.count) + len(some))))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def _tokens(self, pieces: list[str]):
        """Token ids of a stretch of pieces, and the number for each piece."""
        import numpy as np
        import pyarrow as pa

        encoded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        if len(self.index) > STORE:
            self.forget()
        self._learn([p for p in distinct if p not in self.index])
        codes = np.fromiter(map(self.index.__getitem__, distinct), dtype=np.int64, count=len(distinct))[encoded.indices.to_numpy()]
        count = self.count[codes]
        ends = np.cumsum(count)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[codes] - ends + count, count)], count

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, object, bool]]]:
        """Lists of (number of the text, its next ids, whether they are its last), a stretch each."""
        import numpy as np

        pieces: list[str] = []
        parts: list[tuple[int, int, bool]] = []

        def flush():
            ids, count = self._tokens(pieces) if pieces else (np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))
            ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([n for _, n, _ in parts])] if parts else []
            begin = 0
            out = []
            for (doc, _, last), end in zip(parts, ends):
                out.append((doc, ids[begin:end], last))
                begin = end
            pieces.clear(), parts.clear()
            return out

        for doc, text in enumerate(texts):
            found = (m.group() for m in self.split.finditer(text)) if len(text or "") > 4 * STRETCH else iter(self.split.findall(text or ""))
            while True:
                some = list(itertools.islice(found, STRETCH - len(pieces)))
                pieces += some
                last = len(pieces) < STRETCH
                parts.append((doc, len(some), last))
                if last:
                    break
                yield flush()
        yield flush()

    def decode(self, stretch: list[tuple[int, object]]) -> dict[int, bytes]:
        """Bytes of ids by the number that stands with them; one entry for each number that has ids."""
        import numpy as np
        import pyarrow as pa

        sizes = [len(ids) for _, ids in stretch]
        if not sum(sizes):
            return {}
        table = pa.table({
            "doc": np.repeat(np.array([doc for doc, _ in stretch], dtype=np.int64), sizes),
            "position": np.arange(sum(sizes), dtype=np.int64),
            "id": np.concatenate([np.asarray(ids, dtype=np.int32) for _, ids in stretch]),
        })
        self.db.register("stretch", table)
        out = self.db.execute(DECODE).fetchall()
        self.db.unregister("stretch")
        return {doc: bytes.fromhex(text) for doc, text in out}


def _over_batches(docs: DataFrame, ranks_path: str, pattern: str, schema: str, work) -> DataFrame:
    with open(ranks_path, "rb") as file:  # on the driver; under a MB, so that executors need not have the file
        own = file.read()
    codec = Codec(own, pattern)
    known = docs.sparkSession.sparkContext.broadcast((own, codec.proper))
    codec.close()
    _TABLES.clear()

    def run(batches):
        codec = None
        try:
            for batch in batches:
                codec = codec or Codec(known.value[0], pattern, known.value[1])
                yield from work(codec, batch)
        finally:
            if codec:
                codec.close()

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded bytes), and token_ids if asked for.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(codec, batch):
        import numpy as np
        import pyarrow as pa

        texts, first = batch.column(1), 0
        open_: list = []  # count, hashes and ids of the text that the next stretch goes on with
        for stretch in codec.encode(t.as_py() for t in texts):
            plain = codec.decode([(i, ids) for i, (_, ids, _) in enumerate(stretch)])
            done = []
            for i, (_, ids, last) in enumerate(stretch):
                open_ = open_ or [0, hashlib.sha256(), hashlib.sha256(), []]
                open_[0] += len(ids)
                open_[1].update(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                open_[2].update(plain.get(i, b""))
                if with_ids:
                    open_[3].append(ids)
                if last:
                    done.append(open_)
                    open_ = []
            # What a stretch ends goes out at once; a batch's results never stand together.
            count = [d[0] for d in done]
            out = {
                "doc_id": batch.column(0).slice(first, len(done)), "n_tokens": pa.array(count, pa.int64()),
                "ids_sha256": pa.array([d[1].hexdigest() for d in done], pa.string()), "decoded_sha256": pa.array([d[2].hexdigest() for d in done], pa.string()),
            }
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                flat = np.concatenate([ids for d in done for ids in d[3]] + [np.empty(0, dtype=np.int32)])
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            first += len(done)
            yield pa.RecordBatch.from_pydict(out)

    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _over_batches(texts, ranks_path, pattern, schema, work)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token_ids of each text."""
    return round_trip(docs, ranks_path, pattern, True, id_col, text_col).select("doc_id", "token_ids")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and the decoded bytes (binary: a run of ids need not be whole characters); null ids count as none."""
    id_type = tokens.schema[id_col].dataType.simpleString()

    def work(codec, batch):
        import pyarrow as pa

        n = batch.num_rows
        rows = [ids.values.to_numpy(zero_copy_only=False) if ids.values is not None else [] for ids in batch.column(1)]
        plain: dict[int, bytes] = {}
        some: list[tuple[int, object]] = []
        held = 0
        for i, ids in enumerate(rows):
            some.append((i, ids))
            held += len(ids)
            if held >= STRETCH or i == n - 1:
                plain |= codec.decode(some)
                some, held = [], 0
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bytes": pa.array([plain.get(i, b"") for i in range(n)], pa.binary())})

    ids = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return _over_batches(ids, ranks_path, r"\S+", f"doc_id {id_type}, bytes binary", work)
