import random
import re

from cellgrain.llm import ngram_join as nj

from .conftest import EDGES, make


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """(doc_id, class, links) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    words = [re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").lower()).strip() for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if words[i] == words[j] or (union and 5 * inter >= 4 * union):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((rows[i][0], least.get(find(i)), links[i]) for i in range(n)), key=str)


def near_copies(seed=1, groups=12):
    draw = random.Random(seed)
    rows, doc = [], 100
    for g in range(groups):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([6, 12, 60, 200]))]
        for _ in range(draw.choice([1, 2, 5, 9])):
            own = list(words)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = f"x{draw.randint(0, 99)}"
            rows.append((doc, " ".join(own)))
            doc += 1
    return rows


def answers(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    rows = near_copies() + [(5, "A b C d e f"), (6, "a B c D e F"), (7, "a b c d e g h"), (8, ""), (9, None)]
    assert answers(nj.join(make(spark, rows))) == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = near_copies(2, 3) + [(900 + i, "big " * 3 + " ".join(f"t{k}" for k in range(60)) + f" v{i}") for i in range(40)]
    monkeypatch.setattr(nj, "BLOCK", 7)
    assert answers(nj.join(make(spark, rows))) == brute(rows)


def test_ids_that_are_null_or_shared(spark):
    """Rows without an id, and different texts under one id, are compared by their texts."""
    rows = [(None, t) for _, t in near_copies(5, 4)] + [(1, t) for _, t in near_copies(6, 4)]
    got = sorted((r["n_links"], r["n_copies"]) for r in nj.join(make(spark, rows)).collect())
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    assert [g[0] for g in got] == sorted(w[2] for w in want)


def test_edges(edges, empty):
    got = {(r["doc_id"], r["n_copies"]): r for r in nj.join(edges).collect()}
    assert got[7, 3]["class_id"] == 6 and got[7, 3]["n_links"] == 2
    assert got[1, 4]["class_id"] == 1  # null, empty and blank texts are equal
    assert got[10, 1]["class_id"] == got[11, 1]["class_id"] == 10
    assert nj.join(empty).count() == 0 and nj.deduplicate(empty).count() == 0


def test_deduplicate(edges):
    out = nj.deduplicate(edges)
    assert out.columns == edges.columns
    kept = sorted(str(r["doc_id"]) for r in out.collect())
    classes = {r["class_id"] for r in nj.join(edges).collect()}
    assert kept == sorted(map(str, classes)) and len(kept) < len(EDGES)


def test_pruning_keeps_pairs_at_the_threshold():
    """A pair whose values agree as often as 0.8 makes likely is never dropped."""
    least = nj.least_matches(0.8, nj.TOLERANCE)
    assert all(least[n] <= 0.8 * n for n in range(len(least)))
    assert least[192] > 192 * 0.6  # and far pairs are dropped before the sets are touched


def test_key_in_sql_is_that_of_python(edges):
    from pyspark.sql import functions as F

    for r in edges.select("text", nj.text_key(F.col("text")).alias("k")).collect():
        assert bytes(r["k"]) == nj._key(nj._words(r["text"]))


def test_groups_of_blocks_give_the_same(spark, monkeypatch):
    """Pairs of different blocks are found within a group of blocks and across groups."""
    rows = near_copies(3, 3) + [(500 + i, " ".join(f"t{k}" for k in range(70)) + f" v{i % 40} w{i}") for i in range(60)]
    monkeypatch.setattr(nj, "BLOCK", 5)
    for widest in (5, 17):
        monkeypatch.setattr(nj, "WIDEST", widest)
        assert answers(nj.join(make(spark, rows))) == brute(rows)


def test_differences_from_another_set_tell_a_set():
    import numpy as np

    draw = np.random.default_rng(0)
    for n, m in ((0, 5), (5, 0), (1, 9), (100, 90), (64, 64)):
        own, hub = (np.unique(draw.integers(0, 120, size, dtype=np.uint64)) for size in (n, m))
        assert (nj._undelta(nj._delta(own, hub), hub) == own).all()


def test_both_ways_to_intersect_agree():
    import numpy as np

    draw = np.random.default_rng(1)
    base = np.unique(draw.integers(0, 1 << 62, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[draw.random(len(base)) < 0.93], draw.integers(0, 1 << 62, 12, dtype=np.uint64)])) for _ in range(70)]
    at = np.arange(len(sets))
    alive = at[:, None] < at[None, :]
    dense = nj._Sets(sets)
    dense._lay()
    one_by_one = np.zeros_like(alive)
    for i in at:
        one_by_one[i] = nj._Sets(sets).linked(at[i : i + 1], at, alive[i : i + 1])[0]
    assert (dense.linked(at, at, alive) == one_by_one).all() and one_by_one.any() and not one_by_one[alive].all()


def test_raw_hash_is_that_of_sql(edges):
    """Representatives are joined with their texts by the hash that Python made of them."""
    from pyspark.sql import functions as F

    import xxhash

    for r in edges.select("text", F.xxhash64("text").alias("h")).where("text is not null").collect():
        assert xxhash.xxh64_intdigest(r["text"].encode(), seed=42) == r["h"] % (1 << 64)
