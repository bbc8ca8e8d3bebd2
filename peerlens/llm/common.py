"""Helpers shared by the operators of this subpackage."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from peerlens.session import cut, shared_dir

__all__ = ["byte_slices", "cut", "let_through", "shared_dir", "small", "table", "text_digest", "text_pairs", "without"]

SLICE_BYTES = 1 << 20
#: The six characters that count as white space in the contracts of these operators.
SPACE = b" \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch that a task holds at once; one longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Rows of a key table (about 100 bytes each in a task) up to which a join broadcasts it.
BROADCAST_ROWS = 200_000


def table(spark, directory, name):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{directory}/{name}.parquet")


def byte_slices(batches, column, limit=SLICE_BYTES):
    """Arrow batches cut so that `column` holds about `limit` bytes in each piece.

    One row is never split: a longer text is a piece of its own.
    """
    for batch in batches:
        at, size, n = 0, 0, batch.num_rows
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i in range(n):
            if i > at and size + lengths[i] > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += lengths[i]
        if at < n:
            yield batch.slice(at, n - at)


def text_pairs(docs, *more):
    """(doc_id, text as UTF-8 bytes, NULL as empty, `more`), whatever else the table holds."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def text_digest():
    """Column that tells texts under one doc_id apart: 128 bits of the text, NULL for NULL."""
    return F.md5(F.col("text").cast("string").cast("binary"))


def small(rows):
    """`rows` (a written table of short keys), to be broadcast in a join if it has at most BROADCAST_ROWS rows.

    A longer one is left to the planner, which moves both sides.
    """
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def without(docs, rows, how="left_anti"):
    """`docs` without (or, by "left_semi", with only) the rows whose id and text digest are in `rows` (doc_id, digest).

    NULLs equal each other.  The keys are expressions on either side, so columns of `docs` keep their names and order,
    whatever they are.  `rows` is written first: its size decides whether the documents have to move.
    """
    rows = cut(rows.select(F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest")), "rows")
    text = docs["text"].cast("string").cast("binary")
    same = docs["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & F.md5(text).eqNullSafe(rows["digest"])
    return docs.join(small(rows), same, how)


class _Bits:
    """A bitmap over hashed keys of a fixed size."""

    def __init__(self, shared, bits):
        self.shared, self.bits = shared, bits

    def holds(self, key):
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        return self.shared.value[slot >> 3] >> (slot & 7) & 1


def let_through(keys, column, bits=23):
    """A bitmap of 2^bits bits (1 MB) that holds every key of `keys[column]` (64-bit hashes).

    It spares a join most rows that have no partner.  Its size is fixed: with very many keys it lets everything
    through, and the join itself, which decides, gets all rows.
    """
    spark = keys.sparkSession

    def slots(batches):
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            slot = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            word = np.unique(slot)
            yield pa.RecordBatch.from_arrays(
                [pa.array((word >> np.uint64(5)).astype(np.int64)), pa.array(np.left_shift(1, (word & np.uint64(31)).astype(np.int64)))],
                ["word", "mask"],
            )

    words = keys.select(F.col(column).cast("long")).mapInArrow(slots, "word long, mask long")
    table = np.zeros(1 << bits - 5, np.uint32)
    for word, mask in words.groupBy("word").agg(F.bit_or("mask")).collect():  # at most 2^(bits - 5) rows
        table[word] = mask
    return _Bits(spark.sparkContext.broadcast(table.tobytes()), bits)
