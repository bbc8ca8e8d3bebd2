"""The documents of a corpus, stage by stage: identified, unique, uncontaminated, encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), and its result is written and
read again as the next one's `docs`.  All but the last return the columns of `documents`.

Every stage judges rows by id and text, so NULL ids and ids with several texts lose nothing; columns keep their names and
order, whatever they are; an empty table stays empty; texts are read whole, however long.
"""

from peerlens.llm import byte_bpe, decontaminate, exact_dedup, language, simhash
from peerlens.llm.common import cut, table


def identified(spark, docs, sf_dir):
    """Documents whose language is known: those without any letter (NULL and empty too) go, repeated rows each; a NULL
    `lang` is filled where the prediction is clear."""
    return language.drop_unidentified(docs)


def unique(spark, docs, sf_dir):
    """One document of each group of equal texts: the longest original, of equals the smallest id; of repeated rows one.
    NULL and empty texts are one group."""
    return exact_dedup.drop_exact(docs)


def distinct(spark, docs, sf_dir):
    """One document of each component of near-duplicates: that of the smallest id, of several texts under it the one with the
    smallest digest.  Texts without words are one component."""
    return simhash.drop_near(docs)


def clean(spark, docs, sf_dir):
    """Documents that the benchmark's passages do not cover to a twentieth; NULL and empty texts are clean, repeated rows are
    judged each, an empty benchmark leaves all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    """Token counts and digests of every document that is left; a NULL text has no tokens."""
    return byte_bpe.digests(byte_bpe.encode_and_decode(docs))


STAGES = [
    ("language ID", identified),
    ("exact dedup", unique),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("byte-level BPE", encoded),
]

#: Fingerprints, models and merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
