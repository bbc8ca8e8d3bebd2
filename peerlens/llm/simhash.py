"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  One flipped bit changes one
count by one, so the Manhattan distance of two embeddings is at most their Hamming distance.  Embeddings
within distance 2 differ in at most two of six groups of segments; they therefore share a grid cell given
by the exact counts of some four groups (15 choices).  Only cells with two or more different fingerprints
are joined; the pairs in a cell are then verified on the bits.

Equal fingerprints are one node from the start, so copies never make pairs.  A cell of up to `cell_limit`
fingerprints is compared in blocks; a larger one is dealt again by the exact bits of six of eight bytes
(two flipped bits leave six bytes alone), where at most 65,536 fingerprints can meet.  A cell gives
a star of links per group that it joins, never all pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, cut, text_digest, text_pairs, without
from peerlens.llm.components import components

BITS, MAX_DISTANCE, SHINGLE = 64, 2, 3
SEGMENTS, GROUPS = 32, 6
CELL_LIMIT = 2048
_LINKS = "a long, b long"
_HASH_BLOCK = 1 << 16


def fingerprint(raw):
    """SimHash of one text given as UTF-8 bytes."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    ones, hashes = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    done = 0
    while done < n:
        block = np.fromiter((hashes(s, 42) for _, s in zip(range(min(_HASH_BLOCK, n - done)), shingles)), np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in byte_slices(batches, "text"):
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(values.view(np.int64))], ["doc_id", "digest", "fp"]
        )


def fingerprints(docs, digest=None):
    """(doc_id, digest, fp as a signed 64-bit number)."""
    digest = F.lit(None).cast("string") if digest is None else digest
    return text_pairs(docs, digest.alias("digest")).mapInArrow(_fingerprints, "doc_id long, digest string, fp long")


def _group_keys():
    """Column per group: its segments' bit counts packed into one number (0 as 00, 1 as 01, 2 as 11)."""
    bounds = [round(i * SEGMENTS / GROUPS) for i in range(GROUPS + 1)]
    fp, low_bits = F.col("fp"), F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(low_bits), fp.bitwiseAND(high).bitwiseAND(low_bits)
    counts = some.bitwiseOR(F.shiftleft(both, 1))
    for low, high in zip(bounds, bounds[1:]):
        yield F.shiftrightunsigned(counts, 2 * low).bitwiseAND(F.lit((1 << 2 * (high - low)) - 1))


def _cells(nodes):
    """(cell, fp): the cell ids of every choice of groups that may be the equal ones."""
    groups = list(_group_keys())
    chosen = combinations(range(GROUPS), GROUPS - MAX_DISTANCE)
    ids = [F.xxhash64(F.lit(n), *(groups[g] for g in keep)) for n, keep in enumerate(chosen)]
    return nodes.select(F.explode(F.array(*ids)).alias("cell"), "fp")


def _byte_cells(rows):
    """The second deal of a large cell: six of the eight bytes exactly."""
    ids = []
    for n, keep in enumerate(combinations(range(8), 8 - MAX_DISTANCE)):
        mask = sum(0xFF << 8 * b for b in keep)
        ids.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return rows.select(F.explode(F.array(*ids)).alias("cell"), "fp").distinct()


_MASKS = np.array(
    [0] + [1 << i for i in range(BITS)] + [1 << i | 1 << j for i, j in combinations(range(BITS), 2)], np.uint64
)


def star_links(values):
    """Links that join exactly the groups of `values` (distinct, uint64) connected within two bits."""
    values = np.sort(values)
    n = len(values)
    root = np.arange(n)
    if n <= CELL_LIMIT:
        found = []
        for at in range(0, n, 256):
            near = np.bitwise_count(values[at:at + 256, None] ^ values[None, :]) <= MAX_DISTANCE
            a, b = np.nonzero(near)
            found.append(np.stack([a + at, b], 1)[a + at < b])
        pairs = np.concatenate(found)
    else:
        found = []
        for mask in _MASKS[1:]:
            other = values ^ mask
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.nonzero((values[at] == other) & (values < other))[0]
            if len(hit):
                found.append(np.stack([hit, at[hit]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    changed = True
    while changed and len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        changed = not np.array_equal(before, root)
    tied = np.nonzero(root != np.arange(n))[0]
    return values[root[tied]], values[tied]


def _links(batches):
    """Rows sorted by cell -> links.  A cell is held whole: both deals bound its fingerprints."""
    cell, held = None, []

    def settle():
        if held and (total := np.concatenate(held)).size > 1:
            return star_links(np.unique(total))
        return None

    for batch in batches:
        cells, fps = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        starts = np.concatenate([[0], np.nonzero(cells[1:] != cells[:-1])[0] + 1, [len(cells)]])
        out = []
        for low, high in zip(starts, starts[1:]):
            if low == high:
                continue
            if cells[low] != cell:
                out.append(settle())
                cell, held = cells[low], []
            held.append(fps[low:high])
        out = [x for x in out if x is not None]
        if out:
            yield _link_batch(out)
    if (last := settle()) is not None:
        yield _link_batch([last])


def _link_batch(found):
    sides = [np.concatenate(x).view(np.int64) for x in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in sides], ["a", "b"])


def _within(cells):
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, _LINKS)


def near_links(nodes, cell_limit=CELL_LIMIT):
    """Links (a, b) between the different fingerprints of `nodes` (fp), enough to join what lies within two bits."""
    cells = _cells(nodes)
    shared = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    met = cut(cells.join(shared, "cell").select("cell", "fp", "n"), "met")
    links = _within(met.filter(F.col("n") <= cell_limit).select("cell", "fp"))
    large = met.filter(F.col("n") > cell_limit)
    if not shared.filter(F.col("n") > cell_limit).isEmpty():
        again = cut(_byte_cells(large.select("fp").distinct()), "bytecells")
        pairs = again.groupBy("cell").count().filter("count > 1").select("cell")
        links = links.unionByName(_within(again.join(pairs, "cell", "left_semi")))
    return links


def _labels(nodes, cell_limit):
    """`nodes` (fp and others) with the label of each fingerprint's component."""
    labels = components(cut(near_links(nodes.select("fp"), cell_limit), "links"))
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").withColumn("label", F.coalesce("label", "fp")).drop("node")


def simhash_components(docs, cell_limit=CELL_LIMIT):
    """Per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Words are what lies between the six white-space characters, A-Z lower-cased.  NULL and word-less texts
    have fingerprint zero and are linked like any other.  The component id is the smallest doc_id of the
    component (NULL ids count as largest; NULL only if the component has no other).  Repeated rows are
    returned as often as they came; an empty table gives an empty result; a very long text is hashed block by block;
    other columns are not read.
    """
    marks = cut(fingerprints(docs).drop("digest"), "marks")
    nodes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    named = _labels(nodes, cell_limit)
    roots = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = cut(named.join(roots, "label").select("fp", "component_id"), "classes")
    return marks.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs, cell_limit=CELL_LIMIT):
    """`docs` with one row of each component: of its smallest doc_id (NULL last) the text with the smallest digest.

    Rows that share a doc_id, or have none, are told apart by their text; rows alike in both stay together, so what
    stays is one row of each component if exact duplicates went before.
    """
    marks = cut(fingerprints(docs, text_digest()), "marks")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    nodes = cut(marks.groupBy("fp").agg(F.min(row).alias("best")), "nodes")
    best = _labels(nodes, cell_limit).groupBy("label").agg(F.min("best").alias("best"))
    stays = cut(best.select("best.doc_id", "best.digest"), "stays")
    rows = marks.select("doc_id", "digest").distinct()
    same = rows["doc_id"].eqNullSafe(stays["doc_id"]) & rows["digest"].eqNullSafe(stays["digest"])
    return without(docs, rows.join(stays, same, "left_anti"))
