"""Fingerprints against a plain version: bins, densification, packing."""

import random
import re
import struct

import pytest
import xxhash

from cellgrain.llm import fingerprint as fp

from .conftest import EDGES, make


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(parts):
    """Spark's hash of several values: each one's hash is the next one's seed, the first seed is 42."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed=seed)
    return signed(seed)


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * times % (1 << 64)
    return x ^ (x >> 31)


def plain(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return "00" * 256
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] or [words]
    least = {}
    for h in map(chained, shingles):
        at = (h % (1 << 64) >> 56) ^ 0x80  # the top byte, in the order of signed numbers
        least[at] = min(least.get(at, h), h)
    out = []
    for i in range(256):
        source = i
        if i not in least:
            probes = (mixed(i * 1009 + k) % 256 for k in range(1, 25))
            source = next((p for p in probes if p in least), None)
            if source is None:
                source = min(least, key=lambda j: chained([struct.pack("<i", i), struct.pack("<i", j)]))
        out.append(f"{least[source] & 255:02x}")
    return "".join(out)


def alike(a, b):
    share = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 512, 2)) / 256
    return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def test_fingerprints_are_those_of_the_plain_version(spark):
    draw = random.Random(8)
    rows = [t for _, t in EDGES] + [" ".join(draw.choices([f"w{k}" for k in range(300)], k=n)) for n in (5, 6, 7, 9, 20, 60, 150, 400, 2000, 9000)]
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(make(spark, list(enumerate(rows)))).collect()}
    for i, t in enumerate(rows):
        assert got[i] == plain(t), (t or "")[:60]


def test_likeness_is_that_of_the_packed_bytes(spark):
    draw = random.Random(9)
    base = draw.choices([f"w{k}" for k in range(300)], k=500)
    rows = []
    for changes in (0, 10, 60, 500):
        own = list(base)
        for _ in range(changes):
            own[draw.randrange(500)] = f"x{draw.randrange(99)}"
        rows.append(" ".join(own))
    got = {r["doc_id"]: r for r in fp.with_next(make(spark, list(enumerate(rows)))).collect()}
    for i in range(len(rows)):
        assert got[i]["near_next"] == pytest.approx(alike(plain(rows[i]), plain(rows[(i + 1) % len(rows)])))
