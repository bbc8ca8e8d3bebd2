"""The pipeline stage by stage against brute force, and the whole run."""

import hashlib

import corpus_pipeline
from peerlens.llm import decontaminate, exact_dedup, language, simhash
from peerlens.llm.common import cut, table
from peerlens.llm.queries import QUERIES


def test_stages_keep_what_the_operators_keep(spark, data):
    docs = table(spark, data, "documents")
    odd = spark.createDataFrame([(-1, "12 !", "en", "s", 4), (-2, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language ID":
            expected = ids - {-1, -2}
        elif name == "exact dedup":
            expected = {r.doc_id for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
        elif name == "SimHash near-dedup":
            expected = {r.component_id for r in simhash.simhash_components(docs).collect()}
        else:
            bench = table(spark, data, "benchmark")
            expected = {r.doc_id for r in decontaminate.contamination(docs, bench).filter("NOT contaminated").collect()}
        docs = cut(stage(spark, docs, data))
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} == expected
    final = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(final) == len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in final)


def test_run_and_registration(spark, data):
    import __spark_entry__

    assert corpus_pipeline.run(spark, data).count() > 0
    registered = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert language.UNKNOWN == "und"


CLASH = ["_id", "_digest", "_sha", "_n", "_first", "_bad", "digest", "stays", "n", "one", "rows", "body", "hash", "label"]


def test_filters_keep_columns_of_any_name_and_odd_rows(spark):
    """Columns named like anything inside, NULL ids, a third of the rows under one id, repeated rows, empty tables."""
    base = "word%d and other words that make this text of document number %d long enough to differ from all others %d"
    rows = [(i, base % (i, i * 7, i * 31)) for i in range(20)]
    rows += [(5, base % (i, i * 3, i)) for i in range(100, 115)]
    rows += [(None, "a text without id"), (None, "a text without id"), (3, rows[3][1]), (None, None), (41, None), (42, "")]
    bench = " ".join(f"b{i}" for i in range(20))
    rows += [(43, bench), (5, bench + " x"), (None, bench)]
    docs = spark.createDataFrame(
        [(i, t, "en" if n % 2 else None, *[f"{c}{n}" for c in CLASH]) for n, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH),
    )
    benchmark = spark.createDataFrame([(1, bench)], "item_id long, text string")
    key = ["doc_id", "text"]
    texts = lambda df: sorted(map(tuple, df.select(key).collect()), key=repr)
    unique = exact_dedup.drop_exact(docs)
    near = simhash.drop_near(docs)
    clean = decontaminate.drop_contaminated(docs, benchmark)
    known = language.drop_unidentified(docs)
    for out in (unique, near, clean, known):
        assert out.columns == docs.columns
        tags = [int(r["_id"][3:]) for r in out.collect()]  # every row kept is a row of the input, whole
        assert len(set(tags)) == len(tags)
        given = {int(r["_id"][3:]): r for r in docs.drop("lang").collect()}
        assert all(r == given[int(r["_id"][3:])] for r in out.drop("lang").collect())
    assert texts(unique) == sorted({(41 if not t else i, t if t else None) for i, t in rows if (i, t) not in [(None, None), (42, ""), (None, bench)]}, key=repr)
    assert texts(clean) == sorted(((i, t) for i, t in rows if bench not in (t or "")), key=repr)
    assert texts(known) == sorted(((i, t) for i, t in rows if t), key=repr)
    classes = {r.fingerprint for r in simhash.simhash_components(docs).collect()}
    assert len({r.component_id for r in simhash.simhash_components(docs).collect()}) <= near.select(key).distinct().count() <= len(classes)
    for stage in (exact_dedup.drop_exact, simhash.drop_near, language.drop_unidentified, lambda d: decontaminate.drop_contaminated(d, benchmark)):
        assert stage(docs.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)
