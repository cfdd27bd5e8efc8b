"""Fill-in-middle against regular expressions, on hostile rows and on all sequences of a few characters."""

from __future__ import annotations

import itertools
import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text: str) -> tuple:
    units = UNIT.findall(text)
    h = [int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("name", ["docs", "hostile", "empty"])
def test_rows(request, name):
    table = request.getfixturevalue(name)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = sorted(((r["doc_id"], *plain(r["doc_id"], r["text"] or ""), r["text"] or "") for r in table.collect()), key=key)
    got = fill_middle.transform(table).withColumn("restored", fill_middle.restored())
    assert sorted(map(tuple, got.collect()), key=key) == want
    if name == "docs":
        assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_units_of_all_short_texts():
    for n in range(6):
        for text in map("".join, itertools.product("a \n<", repeat=n)):
            units, made = UNIT.findall(text), fill_middle.Units(text)
            assert made.count == len(units)
            assert [made.end(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("<PSM> \n\x85 é😀"), max_size=30), doc_id=st.integers(-5, 10**6))
def test_round_trip_without_spark(text, doc_id):
    n, form, prefix, middle, out = fill_middle.arranged(text.encode(), doc_id, fill_middle.Draws())
    assert (n, form, prefix, middle, out.decode()) == plain(doc_id, text)


def test_bytes_that_are_no_text():
    raw = b"a \xff\xfe b \xc3 c d e f"
    for i in range(40):
        _, form, prefix, _, out = fill_middle.arranged(raw, i, fill_middle.Draws(rate=100))
        assert form != "plain" and sorted(out) == sorted(raw + b"<P><S><M>")


def test_restored_where_sentinels_nearly_arise(spark):
    """Parts that end or begin with pieces of a sentinel."""
    rows = [(i, t) for i, t in enumerate(f"{a} {b}{c} {a}{b} {c}" for a, b, c in itertools.product(["<", "P>", "<P", "<S", "M>", "<<"], repeat=3))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_middle.transform(table, fill_middle.Draws(rate=100)).withColumn("restored", fill_middle.restored()).collect()
    told = dict(rows)
    assert all(r["restored"] == told[r["doc_id"]] for r in got) and sum(r["form"] != "plain" for r in got) > 150
