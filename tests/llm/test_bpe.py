import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cellgrain.llm import bpe

from .conftest import EDGES, make

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["x" * 3000, "ab" * 900, "the" * 300, "日本語" * 90, "\n\n\t  x" * 40, "a\x1cb c\x85d", "0123456789" * 40, "  lead", "it's we'll", "<|endoftext|>"]


def test_round_trip(spark, edges, reference):
    docs = edges.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    texts = [(r[0], r[1] or "") for r in EDGES] + [(100 + i, t) for i, t in enumerate(HARD)]
    want = []
    for doc, text in texts:
        ids = reference.encode_ordinary(text)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_and_bytes(spark, reference):
    docs = make(spark, [(1, "Hello wörld"), (2, None), (3, "x y z")])
    tokens = bpe.encode(docs, PATH, P.PATTERN)
    assert {r["doc_id"]: r["token_ids"] for r in tokens.collect()} == {1: reference.encode_ordinary("Hello wörld"), 2: [], 3: reference.encode_ordinary("x y z")}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(tokens, PATH).collect()} == {1: "Hello wörld".encode(), 2: b"", 3: b"x y z"}


def test_stretches_do_not_matter(reference, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 5)
    monkeypatch.setattr(bpe, "STORE", 8)
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), P.PATTERN)
    texts = ["one two three four five six seven eight nine ten", "", "a b c d e", "f g h i j k l m n o p q r s t u v w x y z" * 3]
    got: dict = {}
    for stretch in codec.encode(texts):
        for doc, ids, _ in stretch:
            got.setdefault(doc, []).extend(ids.tolist())
    assert [got.get(i, []) for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]


def test_empty_table(empty):
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == 0


def contracted(piece, ranks):
    """One contraction a step: the leftmost pair of least rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def rank_file(ranks):
    return b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())


def random_ranks(draw, trained, first=256):
    """Ranks of strings of three letters: of successive merges, or of any strings in any order."""
    ranks = {bytes([i]): i for i in range(256)}
    entries = [b"a", b"b", b"c"]
    while len(entries) < 40:
        new = draw.choice(entries) + draw.choice(entries) if trained else bytes(draw.choices(b"abc", k=draw.randint(2, 5)))
        if new not in entries:
            entries.append(new)
    order = entries[3:] if trained else draw.sample(entries[3:], 37)
    return ranks | {t: first + i for i, t in enumerate(order)}


@pytest.mark.parametrize("seed", range(12))
def test_random_rank_tables(seed):
    """Long pieces take single steps unless the vocabulary is proper; either way the ids are those of single steps."""
    draw = random.Random(seed)
    trained = seed % 2 == 0
    ranks = random_ranks(draw, trained, 256 if seed < 6 else 3_000_000)
    codec = bpe.Codec(rank_file(ranks), r"\S+")
    shown = all(contracted(t, ranks) == [r] for t, r in ranks.items())
    assert codec.proper <= shown  # a proper vocabulary's entries become themselves
    texts = ["".join(draw.choices("abc", k=n)) for n in (1, 7, 99, 101, 300, 700)] + ["a" * 257, "ab" * 130 + "c"]
    got: dict = {}
    for stretch in codec.encode(texts):
        for doc, ids, _ in stretch:
            got.setdefault(doc, []).extend(ids.tolist())
    assert [got[i] for i in range(len(texts))] == [contracted(t.encode(), ranks) for t in texts]
    codec.close()


def test_some_random_tables_are_proper_and_some_not():
    found = {trained: [bpe.Codec(rank_file(random_ranks(random.Random(s), trained)), r"\S+").proper for s in range(6)] for trained in (True, False)}
    assert not all(found[False])
    assert bpe.Codec(rank_file({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}), r"\S+").proper
    # "abc" comes by way of "bc", which ranks above it.
    assert not bpe.Codec(rank_file({bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257}), r"\S+").proper
