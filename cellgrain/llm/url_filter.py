"""URL filter: longest-prefix rules, and naive Bayes over segmented hosts and path tokens.

A url falls into host and path. Rules name a host (with its subdomains) and a path
prefix; of those that fit, the longest decides. All others are judged by a multinomial naive
Bayes classifier over words: labels of the host are cut into words by a unigram Viterbi
segmentation, so that ``cheappillsonline`` yields ``cheap pills online``; the path gives
its letter runs, cut likewise.

Unigram counts: a public tokenizer's whole words (``dictionary``; its path is a parameter, its size the bound of what travels with
the tasks) have a Zipf prior by their rank in the vocabulary, and ``count`` adds how often each stands in the pages' own
texts, over all pages. Class counts come from a labelled training list (``TRAINING``, or the caller's): the
tables have no labels. Every row is judged by itself; rows that a rule decides are neither segmented nor scored.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule
fits it and its words are none, so that the classifier's prior decides (allow); rows that
repeat are judged alike; an empty table gives an empty result; no other column is read. score and words are null where a rule decides.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Training words, as they stand in hosts and paths of either class.
UNWANTED = """
cheap pills pharmacy viagra casino poker bets betting free winner jackpot lottery prize loans payday credit
ads advert banner track tracker click clicks popup spam farm malware phishing warez crack keygen torrent
porn adult escort xxx dating hookup replica watches diet weight miracle crypto profit deals discount coupon
bonus gift cards hacks cheats followers traffic seo backlinks
gambling gamble slot slots roulette bingo wager win sex sexy nude naked cam cams milf erotic pill drugs steroids
rich quick cash forex investment scam fake counterfeit pirated serial nulled virus trojan clickbait affiliate
""".split()
WANTED = """
blog news wiki docs help shop store mail home page index article articles post posts forum library
museum school university college science research health weather sport music film book books recipe recipes travel
guide history garden city council government community open source code project data api learn course
journal press media report paper about contact team support archive category tag author
union bank clinic hospital church charity foundation society institute academy association radio magazine theatre gallery
sports sporting goods farmers market animals kitchen house homes family kids teacher student engineering software
""".split()


def training() -> list[tuple[str, int]]:
    """Labelled urls' words: each listed word alone, and neighbours of a list in pairs."""
    out = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        out += [(w, label) for w in words] + [(f"{a} {b}", label) for a, b in zip(words, words[1:])]
    return out


#: The weight of the public vocabulary's words beside those counted, and the letters of the shortest ones that are taken.
PRIOR_WORDS, SHORTEST = 1_000_000, 3


def dictionary(path: str) -> dict[str, float]:
    """Whole words of a tokenizer's vocabulary file, with prior counts by Zipf's law over their ranks.

    The file lists the vocabulary by id; ids that end words bear ``</w>``. Words of one or two letters are few and listed by no such
    rule of thumb, so only those among the first thousand are taken.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranked = sorted((i, w.removesuffix("</w>")) for w, i in vocabulary.items() if w.endswith("</w>"))
    words = [w for k, (_, w) in enumerate(ranked) if re.fullmatch("[a-z]+", w) and len(w) >= SHORTEST]
    total = sum(1 / (k + 10) for k in range(len(words)))
    return {w: PRIOR_WORDS / (k + 10) / total for k, w in enumerate(words)}


def count(pages: DataFrame, known: dict[str, float], text_col: str = "html") -> dict[str, float]:
    """``known`` with the number of times each of its words stands in the pages' texts added; as many rows come to the driver as there are known words."""
    import pyarrow as pa

    listed = pages.sparkSession.createDataFrame(pa.table({"word": pa.array(list(known), pa.string())}))
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    found = words.groupBy("word").count().join(F.broadcast(listed), "word").collect()
    return known | {r["word"]: known[r["word"]] + r["count"] for r in found}


class Model:
    """Unigram segmentation by counts of words (those of the labelled list where there are no others), and naive Bayes from the labelled list."""

    def __init__(self, rows: list[tuple[str, int]], prior: float = 0.2, threshold: float = 0.5, counts: dict[str, float] | None = None):
        self.by_class = [Counter(w for text, y in rows if y == label for w in text.split()) for label in (0, 1)]
        words = self.by_class[0] + self.by_class[1]
        unigrams: dict[str, float] = dict(words)
        if counts:
            middle = sorted(counts.values())[len(counts) // 2]  # a listed word that the dictionary lacks counts as a common one
            unigrams = counts | {w: max(counts.get(w, 0.0), middle * n) for w, n in words.items()}
        total = sum(unigrams.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in unigrams.items()}
        self.longest = max(map(len, unigrams), default=1)
        self.unknown = math.log(total) + 2  # a letter run outside the list: dear at its start, and more for each letter
        sizes = [sum(c.values()) + len(words) + 1 for c in self.by_class]
        self.llr = {w: math.log((self.by_class[1][w] + 1) / sizes[1]) - math.log((self.by_class[0][w] + 1) / sizes[0]) for w in words}
        self.prior = math.log(prior / (1 - prior))
        self.limit = math.log(threshold / (1 - threshold))
        self.seen: dict[str, list[str]] = {}

    def segment(self, run: str) -> list[str]:
        """The cheapest way to cut ``run`` into listed words and unlisted stretches."""
        if run in self.seen:
            return self.seen[run]
        # best[i]: cost and cut for the first i letters. An unlisted stretch costs its start plus 2.5 a letter.
        known, stray = [0.0], [math.inf]
        cut_known: list[tuple[int, bool]] = [(0, True)]
        cut_stray: list[tuple[int, bool]] = [(0, True)]
        for i in range(1, len(run) + 1):
            best, where = math.inf, (0, True)
            for j in range(max(0, i - self.longest), i):
                if (c := self.cost.get(run[j:i])) is not None:
                    for cost, of in ((known[j], True), (stray[j], False)):
                        if cost + c < best:
                            best, where = cost + c, (j, of)
            known.append(best)
            cut_known.append(where)
            new, on = known[i - 1] + self.unknown + 2.5, stray[i - 1] + 2.5
            stray.append(min(new, on))
            cut_stray.append((i - 1, new <= on))
        out, i, of = [], len(run), known[-1] <= stray[-1]
        while i:
            end = i
            if of:
                i, of = cut_known[i]
            else:
                while True:
                    i, of = cut_stray[i]
                    if of or not i:
                        break
            out.append(run[i:end])
        out.reverse()
        if len(self.seen) < 100_000:
            self.seen[run] = out
        return out

    def words(self, host: str, path: str) -> list[str]:
        runs = re.findall(r"[a-z]+", host) + re.findall(r"[a-z]+", path.lower())
        return [w for run in runs for w in self.segment(run)]

    def score_of(self, words: list[str]) -> float:
        return self.prior + sum(self.llr.get(w, 0.0) for w in words)

    def verdict_of(self, score: float) -> str:
        return "block" if score > self.limit else "allow"

    def score(self, host: str, path: str) -> float:
        """Log-odds that the url is unwanted."""
        return self.score_of(self.words(host, path))

    def verdict(self, host: str, path: str) -> str:
        return self.verdict_of(self.score(host, path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last to be wrapped is asked first
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules=RULES, rows: list[tuple[str, int]] | None = None, vocabulary: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the classifier's log-odds) and words (the segmented tokens) for each row.

    ``vocabulary``: the path of a public tokenizer's file, whose words and the pages' counts of them segment; without it the listed words alone do.
    """
    rows = training() if rows is None else rows
    counts = count(pages, dictionary(vocabulary), text_col) if vocabulary else None
    known = pages.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("score double, words string, verdict string")
    def classify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = Model(rows, counts=known.value)
        for hosts, paths in batches:
            out = []
            for host, path in zip(hosts, paths):
                if host is None:  # a rule decides
                    out.append((None, None, None))
                    continue
                words = model.words(host, path)
                score = model.score_of(words)
                out.append((score, " ".join(words), model.verdict_of(score)))
            yield pd.DataFrame(out, columns=["score", "words", "verdict"])

    host, path = host_and_path(pages[url_col])
    own = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "ruled": verdict})
    free = F.col("rule").isNull()
    own = own.withColumn("model", classify(F.when(free, F.col("host")), F.when(free, F.col("path"))))
    return own.select("page_id", "host", "path", "rule", F.coalesce("ruled", "model.verdict").alias("verdict"), "model.score", "model.words")
