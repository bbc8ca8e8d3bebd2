"""Fill-in-the-middle: the boundary set against sorted arrays, cuts against a plain rewriting, exact round trips."""

import hashlib
import re

import numpy as np
import pytest

from peerlens.llm import fill_in_middle as fim


@pytest.mark.parametrize(
    "offsets, kinds",
    [
        ([], []),
        ([1], [fim.Array]),
        (list(range(1, 70_000)), [fim.Runs, fim.Runs]),
        (list(range(0, 60_000, 2)), [fim.Bitmap]),
        ([5, 65_535, 65_536, 65_537, 200_000], [fim.Array, fim.Array, fim.Array]),
        (list(range(100)) + list(range(65_536, 65_536 + 9000, 2)) + [1 << 20, (1 << 20) + 7], [fim.Runs, fim.Bitmap, fim.Array]),
    ],
)
def test_select(offsets, kinds):
    held = fim.BoundarySet(np.array(offsets, np.int64))
    assert len(held) == len(offsets)
    assert [type(c) for c in held.containers] == kinds
    some = range(len(offsets)) if len(offsets) < 200 else [*range(0, len(offsets), 97), len(offsets) - 1]
    assert [held.select(k) for k in some] == [offsets[k] for k in some]


def test_units():
    def pieces(text, unit):
        raw = text.encode()
        ends = fim.unit_ends(raw, unit).tolist()
        return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]

    for text in ("", "\n", "a", "a\n\nb\n", "ü x\t y\n", " \n z", "漢字 é"):
        assert pieces(text, "line") == re.findall(r"[^\n]*\n|[^\n]+", text)
        assert pieces(text, "char") == list(text)
        assert "".join(pieces(text, "word")) == text
    assert pieces("ab  c\n d", "word") == ["ab  ", "c\n ", "d"]


def plainly(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), out


def test_edges_and_clashing_columns(spark):
    long = "line of text ü\n" * 40_000 + "end"
    rows = [(i, f"a{i}\nb<\n<S\nP>ü\n\n漢", "x", 1) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "", 0), (102, "x<P>y\nz", "o", 0), (103, long, "o", 0), (None, "a\nb", "o", 0)]
    rows += [(104, "\n" * 70_000, "o", 1), (1, rows[1][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    out = fim.transform(docs)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((plainly(i, t) for i, t, *_ in rows), key=repr)
    assert sorted(r.text for r in fim.restore(out).collect()) == sorted(t or "" for _, t, *_ in rows)
    some = fim.transform(docs, seed=3, fim_percent=40, spm_percent=10).collect()
    assert sorted(map(tuple, some), key=repr) == sorted((plainly(i, t, 3, 40, 10) for i, t, *_ in rows), key=repr)
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, unit="page")


@pytest.mark.parametrize("unit", fim.UNITS)
def test_whole_table_comes_back(spark, data, unit):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = fim.digests(fim.transform(docs, unit)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts) and {r.form for r in out} >= {"psm", "spm"}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
