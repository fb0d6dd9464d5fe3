import pytest

#: Columns that clash with names the operators use inside.
CLASHING = ("key", "hash", "row", "pattern", "draw", "size", "node", "group", "label", "kept", "n", "text_key", "score", "norm")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def make(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = []
    for r in rows:
        doc_id, text, source = (*r, "s0")[:3] if len(r) == 2 else r
        full.append((doc_id, text, "en", source, len(text or ""), *["x"] * len(CLASHING)))
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))

EDGES = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "One"), (6, "the quick brown fox jumps over the lazy dog again and again"),
    (7, "the quick brown fox jumps over the lazy dog again and again"), (7, "the quick brown fox jumps over the lazy dog again and again"),
    (None, "an orphan text without any id at all"), (None, None), (8, "É" * 50), (9, "é" * 50), (10, LONG), (11, LONG + " end"), (12, "😀 emoji text 😀"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, EDGES)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
