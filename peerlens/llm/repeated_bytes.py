"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every window of SPAN bytes belongs to one piece of its text and to the group of its anchor hash (`anchors`); equal
windows are in one group.  So groups are independent, and a group of a single piece holds nothing repeated.

1. One pass over the texts lists the pieces: group, digest, place.  No bytes travel.
2. Groups met once are dropped.  A piece that occurs twice as a whole is repeated in full; it is stored once.
3. The bytes of groups with several different pieces are fetched and dealt by group.  A task leaves out
   blocks that are met once, builds the BWT of each shard of what is left and merges them by interleave refinement (`bwt`); windows in repeated intervals are repeated.
4. A group too large for a task (many texts around one common passage) is dealt again: its windows are split by their
   distance from the anchor into two halves, and each half is grouped by the bytes all its windows share.
5. The repeated places of a text are united, and the rest of its bytes is kept.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from peerlens.llm.anchors import SPAN, pieces
from peerlens.llm.bwt import repeated_starts
from peerlens.llm.common import byte_slices, cut, let_through, text_pairs

BATCH_BYTES, GROUP_BYTES = 1 << 20, 2 << 20
#: Distances of a window's start from its anchor lie below this power of two.
_LEVELS = 9

_DOC = "doc_id long, t1 long, t2 long, n_bytes long, sha string"
_WINDOWS = "t1 long, t2 long, hash long, pid long, start int, n int, off int"
_PIECES = "hash long, pid long, full boolean, t1 long, t2 long, start int, off int, low int, body binary"
_SPANS = "t1 long, t2 long, start int, stop int"


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _text_key(raw):
    h = xxhash.xxh3_128_intdigest(raw)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def _batch(schema, columns):
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _texts(batches):
    for batch in byte_slices(batches, "text"):
        raws = [t.as_py() for t in batch.column("text")]
        keys = [_text_key(r) for r in raws]
        yield _batch(_DOC, [
            batch.column("doc_id").to_pylist(), [k[0] for k in keys], [k[1] for k in keys], [len(r) for r in raws],
            [hashlib.sha256(r).hexdigest() for r in raws],
        ])


def _windows(batches):
    for batch in byte_slices(batches, "text"):
        found = [[] for _ in range(7)]
        for text in batch.column("text"):
            raw = text.as_py()
            hashes, starts, counts, offsets = pieces(raw)
            if not len(hashes):
                continue
            t1, t2 = _text_key(raw)
            ends = (starts + counts + SPAN - 1).tolist()
            digest = xxhash.xxh3_64_intdigest
            pids = [digest(raw[a:b], o) for a, b, o in zip(starts.tolist(), ends, offsets.tolist())]
            n = len(hashes)
            for column, values in zip(found, (
                np.full(n, t1), np.full(n, t2), hashes.view(np.int64), np.array(pids, np.uint64).view(np.int64), starts, counts, offsets,
            )):
                column.append(values)
        if found[0]:
            yield _batch(_WINDOWS, [np.concatenate(c) for c in found])


def _cut_out(batches):
    """Rows (text, wanted pieces) -> the pieces with their bytes."""
    for batch in byte_slices(batches, "text", 1 << 20):
        out = [[] for _ in range(9)]
        for t1, t2, text, wanted in zip(*(batch.column(c) for c in ("t1", "t2", "text", "wanted"))):
            raw = text.as_py()
            for w in wanted.as_py():
                row = (w["hash"], w["pid"], w["full"], t1.as_py(), t2.as_py(), w["start"], w["off"], 0, raw[w["start"]:w["start"] + w["n"] + SPAN - 1])
                for column, value in zip(out, row):
                    column.append(value)
        yield _batch(_PIECES, out)


def _merge_groups(batches):
    """Pieces sorted by (hash, pid) -> spans of their texts that are repeated."""
    held, size, group, last = [], 0, None, None

    def settle():
        rows = [h[0] for h in held]
        out = [[] for _ in range(4)]
        if len(rows) > 1:
            for (_, _, full, t1, t2, start, *_), at in zip(rows, repeated_starts([r[8] for r in rows])):
                if full or not len(at):
                    continue
                first = np.concatenate([[0], np.nonzero(np.diff(at) > 1)[0] + 1])
                stop = np.append(first[1:], len(at)) - 1
                for a, b in zip(at[first].tolist(), at[stop].tolist()):
                    for column, value in zip(out, (t1, t2, start + a, start + b + SPAN)):
                        column.append(value)
        # A piece met again in its group (after a group was split) is repeated as a whole.
        for row, more in held:
            for t1, t2, start, n in ([(row[3], row[4], row[5], len(row[8])), *more] if more else ()):
                for column, value in zip(out, (t1, t2, start, start + n)):
                    column.append(value)
        return _batch(_SPANS, out)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != group:
                if size >= BATCH_BYTES:
                    yield settle()
                    held, size = [], 0
                group, last = row[0], None
            if row[1] == last:
                held[-1][1].append((row[3], row[4], row[5], len(row[8])))
                continue
            last = row[1]
            held.append((row, []))
            size += len(row[8])
    if held:
        yield settle()


def _halve(level):
    """Pieces of too large groups -> their two halves by distance from the anchor, in finer groups."""
    width = 1 << _LEVELS - level

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for h, _, full, t1, t2, start, off, low, body in zip(*(c.to_pylist() for c in batch.columns)):
                # Windows begin at distances off, off - 1, ... before the anchor.
                nearest = off - (len(body) - SPAN)
                for cell in range(low, low + 2 * width, width):
                    far, near = min(off, cell + width - 1), max(nearest, cell)
                    if far < near:
                        continue
                    part = body[off - far:off - near + SPAN]
                    # All windows of a cell hold the bytes from its nearest start to its farthest end.
                    common = part[max(0, far - cell):][:max(0, SPAN - width + 1)]
                    finer = xxhash.xxh3_64_intdigest(common, (h ^ cell * 0x9E3779B97F4A7C15 ^ level) & (1 << 64) - 1)
                    pid = xxhash.xxh3_64_intdigest(part, far)
                    row = (_signed(finer), _signed(pid), full, t1, t2, start + off - far, far, cell, part)
                    for column, value in zip(out, row):
                        column.append(value)
            yield _batch(_PIECES, out)

    return run


def _large(groups, limit):
    sizes = groups.groupBy("hash", "pid").agg(F.max(F.octet_length("body")).alias("n"))
    return sizes.groupBy("hash").agg(F.sum("n").alias("bytes"), F.count("*").alias("pids")).filter(
        (F.col("bytes") > limit) & (F.col("pids") > 1)
    ).select("hash")


def repeated_spans(docs, group_bytes=GROUP_BYTES):
    """(t1, t2, start, stop): for each different text (by digest) byte ranges that cover just what is repeated."""
    texts = text_pairs(docs)
    windows = cut(texts.mapInArrow(_windows, _WINDOWS), "windows")
    met = windows.groupBy("hash").agg(F.count("*").alias("met"), F.min("pid").alias("least"), F.max("pid").alias("most"))
    met = cut(met.filter("met > 1").select("hash", (F.col("least") != F.col("most")).alias("several")), "met")
    again = cut(windows.join(met, "hash"), "again")
    whole = again.select("t1", "t2", "start", (F.col("start") + F.col("n") + F.lit(SPAN - 1)).alias("stop"), "several", "hash", "pid")
    spans = whole.filter("NOT several").select("t1", "t2", "start", "stop")

    several = again.filter("several")
    place = F.struct("t1", "t2", "start", "n", "off")
    stored = cut(several.groupBy("hash", "pid").agg(F.count("*").alias("met"), F.min(place).alias("at")), "stored")
    # Written first: by its size the join broadcasts it, or splits the places of a hot piece over several tasks.
    twice = cut(stored.filter("met > 1").select("hash", "pid"), "twice")
    spans = spans.unionByName(whole.filter("several").join(twice, ["hash", "pid"], "left_semi").select("t1", "t2", "start", "stop"))

    item = F.struct("hash", "pid", (F.col("met") > 1).alias("full"), F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.off").alias("off"))
    wanted = stored.groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(F.collect_list(item).alias("wanted"))
    wanted = cut(wanted, "wanted")
    bodies = _keyed(texts, wanted).join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted").mapInArrow(_cut_out, _PIECES)
    # Copies of a text cut out the same pieces.
    groups = cut(bodies.dropDuplicates(["hash", "pid"]), "pieces")

    for level in range(1, _LEVELS + 1):
        large = cut(_large(groups, group_bytes), "large")
        if large.isEmpty():
            break
        spans = spans.unionByName(_merged(groups.join(large, "hash", "left_anti")))
        groups = groups.join(large, "hash", "left_semi").select(*(f.split()[0] for f in _PIECES.split(", ")))
        groups = cut(groups.mapInArrow(_halve(level), _PIECES), "pieces")
        alone = groups.groupBy("hash").count().filter("count > 1").select("hash")
        spans, groups = _collapsed(cut(groups.join(alone, "hash", "left_semi"), "pieces"), spans)
    return spans.unionByName(_merged(groups))


def _collapsed(groups, spans):
    """Store pieces that are now equal once; all their places are repeated as a whole."""
    twice = cut(groups.groupBy("hash", "pid").count().filter("count > 1").select("hash", "pid"), "twice")
    stop = F.col("start") + F.octet_length("body")
    places = groups.filter("NOT full").join(twice, ["hash", "pid"], "left_semi").select("t1", "t2", "start", stop.alias("stop"))
    once = groups.dropDuplicates(["hash", "pid"]).join(twice.withColumn("met", F.lit(True)), ["hash", "pid"], "left")
    once = once.withColumn("full", F.col("full") | F.coalesce("met", F.lit(False)))
    return spans.unionByName(cut(places, "places")), cut(once.select(*(f.split()[0] for f in _PIECES.split(", "))), "pieces")


def _merged(groups):
    rows = groups.select(*(f.split()[0] for f in _PIECES.split(", ")))
    return rows.repartition("hash").sortWithinPartitions("hash", "pid").mapInArrow(_merge_groups, _SPANS)


def _keyed(texts, keys):
    """(doc_id, t1, t2, text) of the texts that may be among `keys`."""
    seen = let_through(keys, "t1")

    def run(batches):
        for batch in byte_slices(batches, "text"):
            rows = [(d, *k, r) for d, r in zip(batch.column("doc_id").to_pylist(), (t.as_py() for t in batch.column("text"))) if seen.holds((k := _text_key(r))[0])]
            if rows:
                yield _batch("doc_id long, t1 long, t2 long, text binary", list(zip(*rows)))

    return texts.mapInArrow(run, "doc_id long, t1 long, t2 long, text binary")


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _keep(batches):
    for batch in byte_slices(batches, "text", 1 << 20):
        out = [[] for _ in range(5)]
        for doc, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
            raw = text.as_py()
            starts = spans.values.field("start").to_numpy(zero_copy_only=False)
            stops = spans.values.field("stop").to_numpy(zero_copy_only=False)
            order = np.argsort(starts, kind="stable")
            starts, stops = starts[order], np.maximum.accumulate(stops[order])
            fresh = np.ones(len(starts), bool)
            fresh[1:] = starts[1:] > stops[:-1]
            first = np.nonzero(fresh)[0]
            begin, end = starts[first].tolist(), stops[np.append(first[1:], len(starts)) - 1].tolist()
            kept = b"".join(raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)]))
            for column, value in zip(out, (doc.as_py(), len(raw), len(raw) - len(kept), len(begin), kept)):
                column.append(value)
        yield _batch(_KEPT, out)


def remove_repeated(docs, group_bytes=GROUP_BYTES):
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (NULL where nothing was removed).

    Bytes covered by a SPAN-byte string that also starts elsewhere, in the same or another row, are removed.
    NULL counts as empty; texts below SPAN bytes keep all; repeated rows are occurrences of their own; an
    empty table gives an empty result; a very long text is cut into pieces by content, and no window is lost at their
    borders; other columns are not read.
    """
    texts = text_pairs(docs)
    rows = cut(texts.mapInArrow(_texts, _DOC), "texts")
    spans = cut(repeated_spans(docs, group_bytes), "spans").distinct()
    spans = cut(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "united")
    changed = _keyed(texts, spans).join(spans, ["t1", "t2"]).select("doc_id", "text", "spans").mapInArrow(_keep, _KEPT)
    changed = changed.withColumn("kept_sha256", F.sha2("kept", 256))
    same = rows.join(spans.select("t1", "t2"), ["t1", "t2"], "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.lit(None).cast("binary").alias("kept"), F.col("sha").alias("kept_sha256"),
    )
    return same.unionByName(changed)
