"""Language identification: held-out accuracy and defined edges."""

import zlib

from peerlens.llm import language
from peerlens.llm.common import table


def test_held_out_accuracy(spark, data):
    docs = table(spark, data.replace("0.001", "0.01"), "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.predictions(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark, data):
    docs = table(spark, data, "documents")
    changed = docs.selectExpr(
        "doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 'zz' ELSE lang END AS lang"
    )
    before = sorted(map(tuple, language.predictions(docs).collect()))
    assert before == sorted(map(tuple, language.predictions(changed).collect()))


def test_edges(spark, data):
    docs = table(spark, data, "documents")
    filters = language.fit(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the"), (4, "the"), (None, "漢字"), (5, "q"), (6, "the and " * 400_000)]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), filters).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows)
    assert [by[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by[None] == (filters.languages[0], 0.0)
    assert by[4][0] == by[6][0] == "en"
    left = language.drop_unidentified(docs.unionByName(spark.createDataFrame([(-1, "--", "en", "s", 2)], docs.schema)))
    assert left.columns == docs.columns and left.filter("doc_id = -1").count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predictions(docs).collect()] == ["und", "und"]
    assert language.predictions(docs.limit(0)).count() == 0


def test_many_languages_share_the_table():
    rows = [(3, 0, 1), (3, 1, 2)]
    filters = language.Filters([f"l{i}" for i in range(10)], rows)
    assert filters.table.shape == (2, 1 << language.TABLE_BITS)
    n, hits = filters.counts(["abc"])
    assert hits.shape == (1, 10) and n[0] > 0


def test_documents_without_any_known_language_stay(spark):
    rows = [(1, "abc", None), (2, None, None), (3, "12 !", None), (None, "漢字", None), (4, "", None), (5, "x 1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = language.drop_unidentified(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {1, None, 5}


def plain_letters(text):
    import re

    return re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", f" {text.lower()} ".encode())


def test_blocks_change_nothing(monkeypatch):
    """Counts of n-grams and popcounts are those of the whole text, wherever blocks end."""
    texts = ["", "a", "the cat  sat -- on the mat", "ÄÖ x" * 9, "  lead and trail  ", "abc" * 50, "1 2 3 a", "漢字 kanji 漢"]
    grams = [plain_letters(t) for t in texts]
    rows = [(slot, 0, 1 + slot % 3) for slot in range(0, 1 << language.TABLE_BITS, 2)]
    for size in (1, 2, 3, 5, 7, 1 << 18):
        monkeypatch.setattr(language, "_BLOCK", size)
        assert [language._letters(t).tobytes() for t in texts] == grams
        filters = language.Filters(["x", "y"], rows)
        n, hits = filters.counts(texts)
        for i, data in enumerate(grams):
            expected, found = 0, [0, 0]
            for width in language.GRAMS:
                for at in range(len(data) - width + 1):
                    expected += 1
                    code = width
                    for byte in data[at:at + width]:
                        code = code << 8 | byte
                    code %= 1 << 64
                    mask = 255
                    for factor in language._FACTORS[: language.PROBES]:
                        h = code * factor % (1 << 64)
                        slot = (h ^ h >> 29) * language._FACTORS[0] % (1 << 64) >> 64 - language.TABLE_BITS
                        mask &= int(filters.table[0, slot])
                    for k in range(2):
                        found[k] += mask >> k & 1
            assert n[i] == expected and hits[i].tolist() == found


def test_scores_by_hand(spark, data):
    """Scores are popcounts corrected by the false-positive rates, from a plain recount."""
    filters = language.fit(table(spark, data, "documents"))
    text = "the whole and le mot der die"
    n, hits = filters.counts([text])
    right = [max((h - n[0] * f) / (1 - f), 0) for h, f in zip(hits[0].tolist(), filters.false)]
    best = max(range(len(right)), key=lambda i: (right[i], -i))
    (name, score), = filters.predict([text])
    assert name == filters.languages[best] and abs(score - right[best] / sum(right)) < 1e-12


def test_null_languages_are_filled(spark, data):
    docs = table(spark, data, "documents")
    hidden = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang", "source", "n_chars")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = language.drop_unidentified(hidden).collect()
    assert all(r.lang == truth[r.doc_id] for r in out if r.doc_id % 4)
    filled = [r for r in out if r.doc_id % 4 == 0 and r.lang is not None]
    assert len(filled) > 20 and sum(r.lang == truth[r.doc_id] for r in filled) / len(filled) > 0.95


def test_the_sample_is_bounded_when_one_id_has_many_rows(spark):
    rows = [(1, f"some words of text {i}", "en") for i in range(2000)] + [(1, "again the same", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    language_cut, language.cut = language.cut, lambda df, name="cut": seen.append((name, out := language_cut(df, name))) or out
    try:
        language.fit(docs, per_language=400)
    finally:
        language.cut = language_cut
    assert 50 < dict(seen)["sample"].count() < 600
