"""Wrapped headers and whole licence files."""

import textwrap

import pytest
from pyspark.sql import functions as F

from cellgrain.llm import licenses

from .conftest import make

GPL = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
MORE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {1} for more details."
PROSE = "def handle(self, packet): queue.append(packet) while sockets remain open elsewhere"
BSD_2 = dict(licenses.HEADERS[::-1])["BSD-2-Clause"]


def wrapped(text, mark="", width=68):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def header(what, licence, version, mark):
    return wrapped(GPL.format(what, licence, version), mark) + f"\n{mark}\n".replace(" \n", "\n") + wrapped(MORE.format(what, licence), mark)


BSD_FILE = "Copyright (c) 2019, Ann Example\nAll rights reserved.\n\n" + wrapped(BSD_2.split("All rights reserved. ")[1])
CASES = {
    "gpl2 hash": ("GPL-2.0", header("program", "General Public License", "2", "# ") + "\nimport os\n" + PROSE),
    "gpl2 between prose": ("GPL-2.0", PROSE + "\n" + wrapped(GPL.format("program", "General Public License", "2")) + "\n" + PROSE),
    "gpl2 in a block": ("GPL-2.0", "int a;\n/*\n" + header("program", "General Public License", "2", "   ") + "\n*/\n" + PROSE),
    "gpl3": ("GPL-3.0", header("program", "General Public License", "3", " * ") + "\n" + PROSE),
    "lgpl2.1": ("LGPL-2.1", header("library", "Lesser General Public License", "2.1", "// ") + "\n" + PROSE),
    "lgpl3": ("LGPL-3.0", header("library", "Lesser General Public License", "3", "// ") + "\n" + PROSE),
    "bsd2 file": ("BSD-2-Clause", BSD_FILE),
    "bsd2 header": ("BSD-2-Clause", "\n".join("# " + x for x in BSD_FILE.split("\n")) + "\n" + PROSE),
    **{f"{name} text": (name, licenses.pkgutil.get_data("cellgrain.llm", f"texts/{name}.txt").decode()) for name in licenses.TEXTS},
}


@pytest.fixture(scope="module")
def found(spark):
    docs = make(spark, [(i, text, f"d{i}/x") for i, (_, text) in enumerate(CASES.values())])
    return {r["doc_id"]: (r["license"], r["score"]) for r in licenses.scan(docs, F.col("source")).collect()}


@pytest.mark.parametrize("case", CASES)
def test_headers_and_texts(found, case):
    assert found[list(CASES).index(case)][0] == CASES[case][0], found
