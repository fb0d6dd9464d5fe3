"""Secret scan by rules and by character Markov models, in SQL functions alone.

Base rules find assignments, access keys and hexadecimal strings. Beside them, runs of ``SHORTEST``
and more characters of the base64 alphabets are scored under two first-order Markov models,
one of random strings and one of ordinary identifiers, both trained from labelled samples;
where the log-likelihood ratio passes ``THRESHOLD`` and no base span overlaps, the run
is a span of kind ``random``.

Training strings come from two sources: digests and identifiers of listed words (``default_sample``), and the table itself
(``table_sample``): what the base rules mark in about ``SAMPLE_DOCS`` of its documents is random (but for mere numbers, such as
those of cards), their other long words are ordinary. So the models know the words of the table's own languages.

The models are bigram counts with add-one smoothing. They are gathered once from the sample
(at most 128 x 128 counts come to the driver) and enter the plan as one constant array.
There is no join, shuffle or Python in the scan itself.

Runs below ``SHORTEST`` are never scored: even random ones seldom reach the threshold there, so lowering the parameter adds
few spans and many runs to score (README has the share that is found by length).

Defined results: a null text counts as empty and has no spans; repeated rows are
scanned each; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, regex_spans

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # whole runs of 16 and more are what is left of all runs once short ones are dropped
KINDS = ("assign", "access", "hex", "random")

THRESHOLD = math.log(1e4)
SAMPLE_ROWS, SAMPLE_DOCS, SEED = 4000, 2000, "s1"
#: Characters of the shortest run that the models score.
SHORTEST = 16


def candidate(shortest: int = SHORTEST) -> str:
    """Whole runs of the base64 alphabets of so many characters at least."""
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{shortest},}}+"


# Words of which ordinary identifiers are made.
IDENTIFIER_WORDS = """
get set add new old user name list file path read write open close start stop begin end index count total value item
key map node tree left right parent child first last next prev size length width height max min sum mean
request response server client handler manager service factory builder provider config option setting default
update delete insert select create remove find search filter sort order group table column row field record
message event listener callback error exception warning debug info log level time date year month day hour
string number integer float double boolean array object class method function variable constant parameter
document page header footer content title author description comment license version release package module
the and for with from into over under between through before after where which there their these those
international development organisation communication responsibility characteristics administration implementation
entwicklung verantwortung geschwindigkeit wissenschaftlich einheitlich mitgliedschaft gesellschaft unterscheidung
naturellement developpement gouvernement particulierement etablissement responsabilite renseignements
desarrollo responsabilidad administracion internacional comunicaciones conocimiento caracteristicas
""".split()


def default_sample(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled strings: (text, random). Digests in several alphabets, and identifiers of listed words in several styles."""
    number = spark.range(rows).select(F.sha2(F.concat(F.lit(SEED), F.col("id").cast("string")), 256).alias("hex"), "id")
    base64 = F.base64(F.unhex("hex"))
    random = number.select(
        F.element_at(F.array(base64, F.translate(base64, "+/=", "-_"), F.regexp_replace(base64, "[+/=]", ""), F.lower(F.regexp_replace(base64, "[+/=]", "")), F.upper("hex"), F.col("hex")), (F.col("id") % 6 + 1).cast("int")).alias("text"),
        F.lit(True).alias("random"),
    )
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")

    def word(i: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64(F.lit(SEED), F.lit(i), "id"), F.lit(len(IDENTIFIER_WORDS))).cast("int"))

    parts = [word(i) for i in range(5)]
    ending = F.when(F.col("id") % 7 == 0, F.concat(F.lit("_"), (F.col("id") % 100).cast("string"))).otherwise("")
    styles = F.array(
        F.concat(F.concat_ws("_", *parts), ending), F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat_ws("-", *parts),
        F.concat_ws("/", *parts), F.upper(F.concat_ws("_", *parts)), F.concat(*parts), F.concat(*[F.initcap(p) for p in parts]),
    )
    ordinary = spark.range(rows).select(F.element_at(styles, (F.col("id") % 7 + 1).cast("int")).alias("text"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def table_sample(docs: DataFrame, docs_wanted: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled strings of a table: (text, random). From about so many documents, by seeded hash, each different string once."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), F.col(id_col).alias("id"))
    part = docs_wanted / max(1, docs.count())
    some = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id", "body"), F.lit(1 << 30)) < F.lit(int(min(1.0, part) * (1 << 30))))
    marked = F.concat(F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("body", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("body", F.lit(HEX), F.lit(0)))
    words = F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z0-9])[A-Za-z][a-z]{7,}(?![A-Za-z0-9])"), F.lit(0))
    strings = F.concat(
        F.transform(F.filter(marked, lambda x: (F.length(x) >= SHORTEST) & x.rlike("[A-Za-z]")), lambda x: F.struct(x.alias("text"), F.lit(True).alias("random"))),
        F.transform(words, lambda x: F.struct(x.alias("text"), F.lit(False).alias("random"))),
    )
    return some.select(F.inline(strings)).distinct()


def train(sample: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of ASCII characters, at 128 * first + second."""
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    pairs = F.transform(F.slice(codes, 2, F.size(codes)), lambda c, i: F.get(codes, i) * 128 + c)
    rows = sample.where(F.length("text") >= 2).select("random", F.explode(pairs).alias("pair")).where("pair between 0 and 16383")
    counts = {(r["random"], r["pair"]): r["count"] for r in rows.groupBy("random", "pair").count().collect()}
    symbols = sum(1 for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-")
    out = [0.0] * 16384
    for a in range(128):
        total = [sum(counts.get((kind, a * 128 + b), 0) for b in range(128)) + symbols for kind in (False, True)]
        for b in range(128):
            n = [counts.get((kind, a * 128 + b), 0) + 1 for kind in (False, True)]
            out[a * 128 + b] = math.log(n[1] / total[1]) - math.log(n[0] / total[0])
    return out


def ratio(text: Column, table: list[float]) -> Column:
    """Log-likelihood ratio, random against ordinary, of an ASCII string."""
    weights = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")  # folds to one constant

    def pairs(codes: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 2), F.lit(0.0), lambda a, i: a + F.get(weights, F.get(codes, i) * 128 + F.get(codes, i + 1)))

    return let(F.transform(F.split(text, ""), lambda c: F.ascii(c)), pairs)


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, sample: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id and, for each kind of ``KINDS``, an array of its spans: struct(start, end, match, group)."""
    if sample is None:
        sample = default_sample(docs.sparkSession).unionByName(table_sample(docs, id_col=id_col, text_col=text_col))
    table = train(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    body = F.col("body")
    rows = rows.select(
        "doc_id",
        F.filter(regex_spans(body, ASSIGN, 2), lambda x: F.length(x["group"]) >= 12).alias("assign"),
        F.filter(regex_spans(body, ACCESS), lambda x: F.length(x["match"]) >= 18).alias("access"),
        regex_spans(body, HEX).alias("hex"),
        F.filter(regex_spans(body, candidate(shortest)), lambda x: ratio(x["match"], table) >= THRESHOLD).alias("candidates"),
    )
    # Only rows with candidates that pass compare them with the base spans.
    base = F.concat("assign", "access", "hex")
    free = F.filter("candidates", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "assign", "access", "hex", F.when(F.size("candidates") > 0, free).otherwise(F.col("candidates")).alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    base = F.concat(*[_of_kind(k, F.col(k)) for k in KINDS[:3]])
    every = F.concat(*[_of_kind(k, F.col(k)) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
