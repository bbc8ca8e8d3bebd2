"""Benchmark decontamination with suffix arrays over shards of the training documents.

The test items are the query set.  They are read in blocks of a bounded size; each block goes to the tasks as
one table of word codes, and all documents pass by it.  A task turns its documents into word codes, builds a
suffix array per shard of a few hundred thousand words, binary-searches every test suffix in it, and gets
from the intervals the positions of all verbatim matches of a window, hence the longest matches.  The array leaves
out suffixes whose first words open no test suffix: they cannot match a window.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, cut, text_digest, text_pairs, without

WINDOW = 13
BLOCK_BYTES = 2 << 20
SHARD_WORDS = 400_000
_TEXT_BLOCK = 1 << 20
#: Bytes that belong to words once A-Z is lower-cased: 0-9, a-z and everything outside ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base, n):
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = _powers(_BASE, _TEXT_BLOCK), _powers(_UNBASE, _TEXT_BLOCK)
_RESULT = (
    "doc_id long, digest string, n_words long, spans array<struct<start:long,stop:long>>, items array<long>, "
    "matches array<struct<item_id:long,start:long,item_start:long,words:long>>"
)


def _blocks(raw):
    """`raw` in pieces that end between words; a word longer than a piece makes its piece longer."""
    at = 0
    while len(raw) - at > _TEXT_BLOCK:
        piece = np.frombuffer(raw, np.uint8, _TEXT_BLOCK, at)
        gaps = np.nonzero(~_WORD[piece])[0]
        end = at + int(gaps[-1]) + 1 if len(gaps) else at + _TEXT_BLOCK
        while not len(gaps) and end < len(raw) and _WORD[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raw):
    """A 64-bit hash per word of a text in UTF-8."""
    found = []
    for piece in _blocks(raw.lower()):
        data = np.frombuffer(piece, np.uint8)
        power, inverse = _POWER, _INVERSE
        if len(data) >= len(power):
            power, inverse = _powers(_BASE, len(data)), _powers(_UNBASE, len(data))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _WORD[data]
        edges = np.diff(inside)
        starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        found.append(h ^ (h >> np.uint64(31)))
    return np.concatenate(found)


class TestSet:
    """The windows of a block of test items, as code sequences that tasks search for."""

    def __init__(self, items, window=WINDOW):
        words = [(item, word_hashes((text or "").encode())) for item, text in items]
        words = [(item, h) for item, h in words if len(h)]
        self.empty = not words
        if self.empty:
            return
        self.vocabulary = np.unique(np.concatenate([h for _, h in words]))
        self.bits = int(len(self.vocabulary)).bit_length()
        self.per_key = 64 // self.bits
        self.columns = -(-window // self.per_key)
        rows = {}
        for item, h in words:
            codes = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
            w = min(window, len(codes))
            for at in range(len(codes) - w + 1):
                rows.setdefault(tuple(codes[at:at + w].tolist()), []).append((item, at))
        self.sizes = np.array([len(w) for w in rows], np.int64)
        self.shortest = int(self.sizes.min())
        self.low, self.high = self._bounds(rows)
        counts = [len(x) for x in rows.values()]
        self.at = np.concatenate([[0], np.cumsum(counts)])
        pairs = [p for x in rows.values() for p in x]
        self.names = sorted({p[0] for p in pairs if p[0] is not None})
        place = {name: i for i, name in enumerate(self.names)}
        self.item = np.array([place.get(p[0], -1) for p in pairs], np.int64)
        self.offset = np.array([p[1] for p in pairs], np.int64)
        # Leading words by which suffixes are let into the array.
        self.lead = min(self.shortest, self.per_key)
        shift = np.uint64(self.bits * (self.per_key - self.lead))
        self.leads = np.unique(self.low[0] >> shift)
        self.shift = shift

    def _bounds(self, rows):
        low = np.zeros((self.columns, len(rows)), np.uint64)
        high = np.zeros_like(low)
        full = (1 << self.bits) - 1
        for n, w in enumerate(rows):
            for side, fill in ((low, 0), (high, full)):
                padded = [*w, *[fill] * (self.columns * self.per_key - len(w))]
                for c in range(self.columns):
                    value = 0
                    for code in padded[c * self.per_key:(c + 1) * self.per_key]:
                        value = value << self.bits | code
                    side[c, n] = value
        return low, high

    def codes(self, hashes):
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)

    def suffix_array(self, codes):
        """(positions, key columns) of the suffixes of `codes` that may match, in lexicographic order."""
        n, width = len(codes), self.columns * self.per_key
        padded = np.zeros(n + width, np.uint64)
        padded[:n] = codes
        first = np.zeros(n, np.uint64)
        for i in range(self.per_key):
            first = first << np.uint64(self.bits) | padded[i:i + n]
        lead = first >> self.shift
        at = np.minimum(np.searchsorted(self.leads, lead), len(self.leads) - 1)
        positions = np.nonzero(self.leads[at] == lead)[0]
        keys = []
        for c in range(self.columns):
            key = np.zeros(len(positions), np.uint64)
            for i in range(self.per_key):
                key = key << np.uint64(self.bits) | padded[positions + c * self.per_key + i]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        return positions[order], [k[order] for k in keys]

    def search(self, keys, wanted, after):
        """Binary search of all `wanted` key tuples at once: first place not below (or above) each."""
        low = np.zeros(wanted.shape[1], np.int64)
        high = np.full(wanted.shape[1], len(keys[0]), np.int64)
        while True:
            busy = low < high
            if not busy.any():
                return low
            mid = np.minimum((low + high) // 2, len(keys[0]) - 1)
            less = np.zeros(len(low), bool)
            equal = np.ones(len(low), bool)
            for key, want in zip(keys, wanted):
                value = key[mid]
                less |= equal & (value < want)
                equal &= value == want
            right = less | equal if after else less
            low, high = np.where(busy & right, mid + 1, low), np.where(busy & ~right, mid, high)

    def occurrences(self, codes):
        """(position, window) of every verbatim occurrence of a window in `codes`, shard by shard."""
        positions, windows = [], []
        for at in range(0, max(len(codes), 1), SHARD_WORDS):
            shard = codes[at:at + SHARD_WORDS + WINDOW - 1]
            places, keys = self.suffix_array(shard)
            if not len(places):
                continue
            low, high = self.search(keys, self.low, False), self.search(keys, self.high, True)
            counts = high - low
            hit = np.nonzero(counts > 0)[0]
            counts = counts[hit]
            index = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            found = places[index]
            inside = found < SHARD_WORDS
            positions.append(found[inside] + at)
            windows.append(np.repeat(hit, counts)[inside])
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(positions), np.concatenate(windows)

    def matches(self, positions, windows):
        """Longest match per item: arrays (item, start, item_start, words)."""
        counts = np.diff(self.at)[windows]
        index = np.repeat(self.at[windows] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        item, offset = self.item[index], self.offset[index]
        start, size = np.repeat(positions, counts), np.repeat(self.sizes[windows], counts)
        order = np.lexsort((start, start - offset, item))
        item, offset, start, size = item[order], offset[order], start[order], size[order]
        fresh = np.ones(len(item), bool)
        diagonal = start - offset
        fresh[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.nonzero(fresh)[0]
        last = np.append(first[1:], len(item)) - 1
        words = start[last] - start[first] + size[last]
        best = np.lexsort((start[first], -words, item[first]))
        keep = np.ones(len(best), bool)
        keep[1:] = item[first][best][1:] != item[first][best][:-1]
        best = best[keep]
        return item[first][best], start[first][best], offset[first][best], words[best]


def _spans(starts, sizes):
    """Disjoint [start, stop) that cover the given runs."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate((starts + sizes)[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > stops[:-1]
    first = np.nonzero(fresh)[0]
    return starts[first], stops[np.append(first[1:], len(starts)) - 1]


def _task(shared):
    def run(batches):
        tests = shared.value
        for batch in byte_slices(batches, "text"):
            raws = [t.as_py() for t in batch.column("text")]
            hashes = [word_hashes(r) for r in raws]
            # Code zero between documents: no window holds it.
            bounds = np.cumsum([0] + [len(h) + 1 for h in hashes])
            out = {"spans": [[] for _ in raws], "items": [[] for _ in raws], "matches": [[] for _ in raws]}
            if not tests.empty:
                gap = np.zeros(1, np.uint32)
                codes = np.concatenate([x for h in hashes for x in (tests.codes(h), gap)])
                positions, windows = tests.occurrences(codes)
                owner = np.searchsorted(bounds, positions, side="right") - 1
                order = np.argsort(owner, kind="stable")
                positions, windows, owner = positions[order], windows[order], owner[order]
                docs, first = np.unique(owner, return_index=True)
                for d, low, high in zip(docs.tolist(), first, np.append(first[1:], len(owner))):
                    local, w = positions[low:high] - bounds[d], windows[low:high]
                    starts, stops = _spans(local, tests.sizes[w])
                    out["spans"][d] = [{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist())]
                    for item, start, offset, n in zip(*(x.tolist() for x in tests.matches(local, w))):
                        name = tests.names[item] if item >= 0 else None
                        out["matches"][d].append({"item_id": name, "start": start, "item_start": offset, "words": n})
                        if name is not None:
                            out["items"][d].append(name)
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            match = pa.struct([(n, pa.int64()) for n in ("item_id", "start", "item_start", "words")])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), pa.array([len(h) for h in hashes], pa.int64()),
                    pa.array(out["spans"], pa.list_(span)), pa.array(out["items"], pa.list_(pa.int64())),
                    pa.array(out["matches"], pa.list_(match)),
                ],
                ["doc_id", "digest", "n_words", "spans", "items", "matches"],
            )

    return run


def _covered(spans):
    """Words covered by spans that may overlap (they come from different blocks of items)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("stop"))

    def add(acc, s):
        extra = F.greatest(s["stop"] - F.greatest(s["start"], acc["stop"]), F.lit(0).cast("long"))
        return F.struct((acc["total"] + extra).alias("total"), F.greatest(acc["stop"], s["stop"]).alias("stop"))

    return F.aggregate(F.array_sort(spans), start, add)["total"]


def _verdicts(docs, benchmark, block_bytes=BLOCK_BYTES, window=WINDOW):
    """`contamination` with the digest of each row's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(items.distinct(), "items")  # copies of an item change no result, and would all meet in one block
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    pairs = text_pairs(docs, text_digest().alias("digest"))
    found = []
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        tests = TestSet([tuple(r) for r in part.collect()], window)  # about block_bytes of text
        found.append(pairs.mapInArrow(_task(spark.sparkContext.broadcast(tests)), _RESULT))
    rows = found[0]
    if n_blocks > 1:
        rows = rows.withColumn("block", F.lit(0))
        for n, more in enumerate(found[1:], 1):
            rows = rows.unionByName(more.withColumn("block", F.lit(n)))
        # Rows that share id and text have equal answers: one set per block, and the number of rows.
        rows = rows.groupBy("doc_id", "digest", "n_words").agg(
            F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"),
            F.flatten(F.collect_set("matches")).alias("matches"), F.count_if(F.col("block") == 0).alias("times"),
        ).withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    n_hit, items = _covered(F.col("spans")), F.array_distinct("items")
    return rows.select(
        "doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "matches",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs, benchmark, block_bytes=BLOCK_BYTES, window=WINDOW):
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items (ids), matches (longest per item), contaminated.

    Words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z.  A NULL or word-less text has no words and is clean.
    Items without words have no window; items of one id count once; an item without id hits but is not listed.
    An empty benchmark leaves all documents clean; an empty table gives an empty result.  Repeated rows are answered each; a very
    long text is searched shard by shard, matches across shards included; other columns are not read.
    """
    return _verdicts(docs, benchmark, block_bytes, window).drop("digest")


def drop_contaminated(docs, benchmark, **options):
    """`docs` without the contaminated rows; rows that share a doc_id, or have none, are told apart by their text."""
    return without(docs, _verdicts(docs, benchmark, **options).filter("contaminated").select("doc_id", "digest").distinct())
