"""Personal data that ends a sentence or is grouped otherwise."""

import re

import pytest

from cellgrain.llm import pii

FOUND = [
    ("call me at 555-123-4567.", "phone_national", "555-123-4567"),
    ("Call (555) 123-4567. Thanks", "phone_national", "(555) 123-4567"),
    ("phone (555)123-4567 please", "phone_national", "(555)123-4567"),
    ("tel 030 1234567, thanks", "phone_national", "030 1234567"),
    ("appel: 01 23 45 67 89.", "phone_national", "01 23 45 67 89"),
    ("iban NO9386011117947 please", "iban", "NO9386011117947"),
    ("iban NO93 8601 1117 947.", "iban", "NO93 8601 1117 947"),
]


@pytest.mark.parametrize(("text", "kind", "span"), FOUND)
def test_candidates_are_proposed_and_found(text, kind, span):
    assert span in [m.group() for m in pii.PROPOSE[kind].finditer(text)]
    assert (text.index(span), pii.KINDS.index(kind), text.index(span) + len(span)) in pii.model().spans(text)


def test_a_full_stop_does_not_hide_a_candidate():
    assert [m.group() for m in pii.PROPOSE["phone_national"].finditer("Tel 0171 1234 5678.")] == ["0171 1234 5678"]


@pytest.mark.parametrize("text", ["12.345.678.901", "555-123-4567.8", "555-123-4567-9", "555-123-45678901"])
def test_parts_of_longer_numbers_are_not_proposed(text):
    assert not pii.PROPOSE["phone_national"].search(text)


def test_unproposed_spans_count_as_misses(monkeypatch):
    n = sum(r[4] for r in pii.sample(400, seed=3) if r[3] == "iban")
    monkeypatch.setitem(pii.PROPOSE, "iban", re.compile("never"))
    rows = [r for r in pii.sample(400, seed=3) if r[3] == "iban"]
    model = pii.Model(pii.sample(400, seed=3))
    assert n == len(rows) > 0 and model.recall["iban"] == 0 and all(model.probability(*r[:4]) == 0 for r in rows)


def test_generators_miss_no_generated_span():
    assert not [r for r in pii.sample(2000, seed=99) if r[1] == r[2]]
