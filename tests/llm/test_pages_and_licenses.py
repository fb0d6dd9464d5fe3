import re

import pytest
from pyspark.sql import functions as F

from cellgrain.llm import licenses, url_filter

from .conftest import make

URLS = [
    "https://blog.tion.example.com/de/85/", "http://x.example.org/fr/1", "http://X.Example.NET/en/7?a=b", "https://a.net/", "https://a.net", "http://org/fr/", "http://xorg/fr/",
    "https://cheap-pills.example.com/en/1", "https://m.freebets.example.com", "no scheme", None, "", "://", "ftp://h?q#f", "http://h#f?x", "http://example.com/DE/1", "x://y://z/de/",
    "http://" + "a" * 5000 + ".com/" + "b" * 5000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fit = [(len(d + p), d + p, v) for v, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    model = url_filter.Model(url_filter.training())
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = parts(URLS[r["page_id"]])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (verdict or model.verdict(host, path))
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_segmentation_and_classes():
    model = url_filter.Model(url_filter.training())
    assert model.segment("cheappillsonline") == ["cheap", "pills", "online"]
    assert model.segment("freecasinobonus") == ["free", "casino", "bonus"]
    assert model.segment("ththing") == ["ththing"] and model.segment("") == []
    assert "".join(model.segment("xyzcheapqqpills")) == "xyzcheapqqpills"
    for bad in ("cheap-pills.example.com", "freebets.example.com", "spam-farm.example.org", "ads-track.example.com"):
        assert model.verdict(bad, "/en/1") == "block"
    for good in ("blog.example.com", "ththing.example.org", "university-library.example.com", ""):
        assert model.verdict(good, "/en/1.html") == "allow"


def test_verdicts_are_right_on_held_out_words():
    """Words in pairs that training did not see together."""
    bad = [a + b for a, b in zip(url_filter.UNWANTED[::2], url_filter.UNWANTED[7::2])]
    good = [a + b for a, b in zip(url_filter.WANTED[::2], url_filter.WANTED[9::2])]
    model = url_filter.Model(url_filter.training())
    assert sum(model.verdict(h + ".com", "/") == "block" for h in bad) / len(bad) > 0.9
    assert sum(model.verdict(h + ".com", "/") == "allow" for h in good) / len(good) > 0.95


FILES = [
    (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files, to deal in the Software without restriction", "repo/LICENSE"),
    (2, "x = 1", "repo/src/a.py"),
    (3, "This library is licensed under the GNU Lesser General Public License, version 3.", "repo/src/vendor/COPYING"),
    (4, "int x;", "repo/src/vendor/deep/er/b.c"),
    (5, "// nothing", "other/c.c"),
    (6, "// Licensed under the Apache License, Version 2.0.", "repo/d.c"),
    (7, "x", None),
    (8, None, "repo/e.c"),
    (9, "Driving license offices reserved all copyright questions for the people of the town", "top.c"),
    (10, "", "/abs/x"),
    (11, "Some words.\nRELEASED under the MIT license.\nMore words", "z"),
]


def test_license_scan(spark, empty):
    docs = make(spark, FILES)
    got = {r["doc_id"]: (r["license"], r["origin"], r["origin_directory"]) for r in licenses.scan(docs, F.col("source")).collect()}
    assert got[1] == ("MIT", "file", "repo") and got[2] == ("MIT", "inherited", "repo") and got[8] == ("MIT", "inherited", "repo")
    assert got[3][:2] == ("LGPL-3.0", "file") and got[4] == ("LGPL-3.0", "inherited", "repo/src/vendor")
    assert got[6][:2] == ("Apache-2.0", "header") and got[11][:2] == ("MIT", "header")
    assert all(got[i] == (None, None, None) for i in (5, 7, 9, 10))
    assert len(got) == len(FILES) and licenses.scan(empty, F.col("source")).count() == 0


@pytest.mark.parametrize("name", ["/LICENSE", "LICENSE"])
def test_files_at_the_root(spark, name):
    docs = make(spark, [(1, "Released under the ISC license.", name), (2, "x", name.replace("LICENSE", "a/b/c"))])
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs, F.col("source")).collect()}
    assert got == {1: "ISC", 2: "ISC"}


def test_every_statement_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "version 3.": "GPL-3.0", "Apache License, Version 2.0.": "Apache-2.0", "under the MIT License.": "MIT", "All rights reserved.": "proprietary"}
    found = {r["doc_id"]: r["license"] for r in licenses.scan(docs, F.concat_ws("/", "source", "doc_id")).collect()}
    for r in docs.collect():
        names = {v for k, v in want.items() if any(k in part for part in (r["text"] or "").split("\n"))}
        assert found[r["doc_id"]] in names if names else found[r["doc_id"]] is None
