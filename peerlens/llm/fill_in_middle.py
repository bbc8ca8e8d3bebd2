"""Fill-in-the-middle transformation over a Roaring-style set of unit boundaries.

The ends of a text's units (lines, words or code points, as UTF-8 byte offsets) form a compressed set: containers
of 2^16 offsets, each an array, a bitmap or a list of runs, whichever is smallest, under a table of cumulative
cardinalities.  "The end of unit k" is a search for the container in that table and a local select inside it, so both
cuts come from the set alone.  Cuts, form and rates follow from a hash of the document's id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, text_pairs

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "word", "char")
_SPAN = 1 << 16
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class Array:
    """Up to a few thousand offsets, two bytes each."""

    def __init__(self, low):
        self.low = low.astype(np.uint16)

    def select(self, k):
        return int(self.low[k])


class Bitmap:
    """2^16 bits with the ranks of its 64-bit words."""

    def __init__(self, low):
        bits = np.zeros(_SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.ranks = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k):
        word = int(np.searchsorted(self.ranks, k, side="right"))
        before = int(self.ranks[word - 1]) if word else 0
        inside = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.nonzero(inside)[0][k - before])


class Runs:
    """Starts of runs of consecutive offsets with the cardinalities before them."""

    def __init__(self, low, first):
        self.starts = low[first].astype(np.uint16)
        self.before = first.astype(np.uint16)

    def select(self, k):
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(low):
    """The smallest container for sorted offsets below 2^16."""
    first = np.concatenate([[0], np.nonzero(np.diff(low) != 1)[0] + 1])
    bytes_of = {Array: 2 * len(low), Bitmap: _SPAN // 8, Runs: 4 * len(first)}
    kind = min(bytes_of, key=bytes_of.get)
    return Runs(low, first) if kind is Runs else kind(low)


class BoundarySet:
    """A sorted set of offsets that answers `select`."""

    def __init__(self, offsets):
        high = offsets // _SPAN
        starts = np.nonzero(np.diff(high, prepend=-1))[0]
        stops = np.append(starts[1:], len(offsets))
        self.keys = high[starts]
        self.totals = stops  # cumulative cardinalities
        self.containers = [container(offsets[a:b] % _SPAN) for a, b in zip(starts, stops)]

    def __len__(self):
        return int(self.totals[-1]) if len(self.totals) else 0

    def select(self, k):
        """The k-th smallest offset, from zero."""
        at = int(np.searchsorted(self.totals, k, side="right"))
        before = int(self.totals[at - 1]) if at else 0
        return int(self.keys[at]) * _SPAN + self.containers[at].select(k - before)


def unit_ends(raw, unit="line"):
    """Byte offsets after each unit of a text in UTF-8: lines with their line feed, words with the white space that
    follows them (white space at the start is a unit), or code points."""
    data = np.frombuffer(raw, np.uint8)
    if unit == "line":
        last = data == 10
    elif unit == "word":
        space = (data == 32) | (data >= 9) & (data <= 13)
        last = np.append(space[:-1] & ~space[1:], False)
    else:
        last = np.append((data[1:] & 0xC0) != 0x80, False)
    ends = np.nonzero(last)[0] + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return ends


def _chars(raw):
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _transform(unit, fim_percent, spm_percent, marks):
    prefix_mark, suffix_mark, middle_mark = marks

    def one(raw, h1, h2, h3, h4):
        ends = BoundarySet(unit_ends(raw, unit))
        n = len(ends)
        if not raw or any(m in raw for m in marks) or h3 % 100 >= fim_percent:
            return n, "plain", None, None, raw
        a, b = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        if h4 % 100 < spm_percent:
            form, out = "spm", (suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)
        else:
            form, out = "psm", (prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)
        return n, form, _chars(prefix), _chars(middle), b"".join(out)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in byte_slices(batches, "text"):
            hashes = [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
            rows = [one(t.as_py(), *h) for t, *h in zip(batch.column("text"), *hashes)]
            found = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            output = pa.array([r[4] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *found, output],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def transform(docs, unit="line", seed=SEED, fim_percent=FIM_PERCENT, spm_percent=SPM_PERCENT, marks=(PREFIX, SUFFIX, MIDDLE)):
    """Per row of `docs`: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The first four groups of eight hex digits of the SHA-256 of "<seed>:<doc_id>" choose the cuts (both modulo n + 1),
    whether the text is cut at all, and the order: `psm` is prefix, suffix, middle, `spm` suffix, prefix, middle.
    A text that is NULL (counts as empty), empty, holds a mark or is not drawn stays `plain`, its counts NULL.  Equal cuts
    give an empty middle.  A NULL doc_id hashes as the empty string.  Repeated rows are answered each; an empty table gives an
    empty result; a very long text is one value of its task, its set a few bytes per boundary; only doc_id and text are read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    hashes = [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)
    ]
    work = _transform(unit, fim_percent, spm_percent, [m.encode() for m in marks])
    return text_pairs(docs, *hashes).mapInArrow(work, _RESULT).withColumn("output", F.col("output").cast("string"))


def restore(transformed, marks=(PREFIX, SUFFIX, MIDDLE)):
    """`transformed` with `text`, rebuilt from `output` and `form` alone.

    A text that was cut holds no mark, so the first of each mark is the one that was set.
    """
    prefix_mark, suffix_mark, middle_mark = marks

    def parts(first, second):
        """What follows each mark, in the order of the output."""
        output = F.col("output")
        at, last = F.locate(second, output), F.locate(middle_mark, output)
        return (
            F.substring(output, len(first) + 1, at - len(first) - 1),
            F.substring(output, at + len(second), last - at - len(second)),
            F.substring(output, last + len(middle_mark), F.char_length(output)),
        )

    prefix, suffix, middle = parts(prefix_mark, suffix_mark)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(suffix_mark, prefix_mark)
    spm = F.concat(prefix, middle, suffix)
    text = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output"))
    return transformed.withColumn("text", text)


def digests(transformed, marks=(PREFIX, SUFFIX, MIDDLE)):
    """`transformed` with SHA-256 digests in place of the output: of the output, and of the text restored from it."""
    return restore(transformed, marks).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"),
    )
