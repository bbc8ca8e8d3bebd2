"""Ranked lexical search over posting lists that are blocked geometrically, term by term.

1. One pass over the documents gives the forward index: length, and the counts of the terms that some item has.
   Collection statistics (N, L, df) are sums over it.
2. A task takes the forward index shard by shard.  The posting list of a term is cut into blocks of similar
   documents (the nearest of a few centres under a random projection of the document vectors), whatever their
   ids, and each block stores the coordinatewise maximum of its documents' contributions as its summary.
3. An item visits its terms by falling largest contribution.  A block is skipped only if its summary's product with the item
   is below the score of the item's last kept document, and the remaining lists only if all their largest contributions together
   are; every other document is scored exactly on the forward index.  All scores and bounds are integers.
4. A task hands on its best documents of each item; the ranks come from two rounds of top-k by (item, part) and item.

Blocks are made when a list is first visited; lists that no item visits in a shard have none.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, cut, let_through, text_pairs

TOP = 20
#: Text of the items that one pass over the forward index serves (broadcast).
BLOCK_BYTES = 2 << 20
SHARD_POSTINGS = 200_000
BLOCK_DOCS, SKETCH = 64, 32
#: Cells (terms times blocks) up to which a list's summaries are gathered in a dense table, beyond by sorting.
DENSE = 1 << 21
_PARTS = 32
_FORWARD = "doc_id long, n long, terms array<binary>, counts array<long>"
_FOUND = "key long, doc_id long, score long"
#: Bytes of terms (0-9, a-z after lower-casing, everything outside ASCII) as they are, all others as spaces.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw):
    """Terms of a text in UTF-8, only A-Z lower-cased, repeats included."""
    return raw.lower().translate(_TABLE).split()


def _forward(wanted):
    def run(batches):
        known = {}
        for batch in byte_slices(batches, "text"):
            sizes, names, counts = [], [], []
            for text in batch.column("text"):
                held, total = {}, 0
                for t in terms(text.as_py()):
                    total += 1
                    held[t] = held.get(t, 0) + 1
                found = []
                for t in held:
                    use = known.get(t)
                    if use is None:
                        if len(known) > 200_000:
                            known.clear()
                        use = known[t] = wanted.holds(xxhash.xxh64_intdigest(t, 42))
                    if use:
                        found.append(t)
                sizes.append(total)
                names.append(found)
                counts.append([held[t] for t in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(names, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return run


def _item_terms(batches):
    for batch in byte_slices(batches, "text"):
        keys, names = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            found = terms(text.as_py())
            keys += [key] * len(found)
            names += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.binary())], ["key", "term"])


def weight(df, total):
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


class Items:
    """A block of items: their terms' weights, and per item its terms with repeats."""

    def __init__(self, rows, stats, n_docs, n_terms):
        """`rows` (key, term, repeats); `stats` (term, df)."""
        self.n_docs, self.n_terms = n_docs, n_terms
        stats = sorted((bytes(t), n) for t, n in stats)
        self.names = [t for t, _ in stats]
        self.weights = np.array([weight(df, n_docs) for _, df in stats], np.int64)
        self.signs = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (len(stats), SKETCH))
        place = {t: i for i, t in enumerate(self.names)}
        held = {}
        for key, term, n in rows:
            if bytes(term) in place:
                held.setdefault(key, {})[place[bytes(term)]] = n
        self.items = [
            (key, np.array(sorted(q), np.int64), np.array([q[t] for t in sorted(q)], np.int64)) for key, q in sorted(held.items())
        ]


class Blocks:
    """One posting list in blocks of similar documents, each with its coordinatewise maximum."""

    def __init__(self, shard, rows):
        n = -(-len(rows) // BLOCK_DOCS)
        centres = rows[np.arange(n) * len(rows) // n]
        nearest = (shard.sketch[rows] @ shard.sketch[centres].T).argmax(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
        order = np.argsort(nearest, kind="stable")
        self.rows, block = rows[order], nearest[order]
        used, self.starts = np.unique(block, return_index=True)
        self.starts = np.append(self.starts, len(rows))
        self.n = len(used)
        block = np.searchsorted(used, block)
        index, sizes = shard.entries(self.rows)
        key = shard.term[index] * self.n + np.repeat(block, sizes)
        if shard.width * self.n <= DENSE:
            most = np.zeros(shard.width * self.n, np.int64)
            np.maximum.at(most, key, shard.value[index])
            key = np.nonzero(most)[0]
            self.largest = most[key]
        else:
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            self.largest = np.maximum.reduceat(shard.value[index][order], first)
        self.terms, self.blocks = key // self.n, key % self.n

    def bounds(self, wanted, repeats):
        """Product of each block's summary with an item."""
        low, high = np.searchsorted(self.terms, wanted), np.searchsorted(self.terms, wanted, side="right")
        index, sizes = _ranges(low, high)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.blocks[index], self.largest[index] * np.repeat(repeats, sizes))
        return out

    def members(self, chosen):
        return self.rows[_ranges(self.starts[chosen], self.starts[chosen + 1])[0]]


def _ranges(low, high):
    """(all places of the ranges one after another, sizes of the ranges)."""
    sizes = high - low
    ends = np.cumsum(sizes)
    return np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


class Shard:
    """Some documents of the forward index as vectors of contributions, and their posting lists."""

    def __init__(self, items, ids, sizes, rows, term, count):
        """`ids` and `sizes` per document; (row, term number, count) per posting, sorted by row."""
        m = 75 + 25 * sizes * items.n_docs // max(items.n_terms, 1)
        value = items.weights[term] * (1_000_000_000 * count // (1000 * count + 12 * m[rows]))
        some = value > 0
        rows, self.term, self.value = rows[some], term[some], value[some]
        self.ids, self.n = ids, len(sizes)
        self.at = np.searchsorted(rows, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        self.posted, names = rows[order], self.term[order]
        self.names, first = np.unique(names, return_index=True)
        self.first = np.append(first, len(names))
        self.peak = np.maximum.reduceat(self.value[order], first) if len(first) else np.zeros(0, np.int64)
        self.sketch = np.zeros((self.n, SKETCH), np.float32)
        filled = np.nonzero(np.diff(self.at))[0]
        if len(filled):
            parts = items.signs[self.term] * self.value[:, None].astype(np.float32)
            self.sketch[filled] = np.add.reduceat(parts, self.at[filled])
        norm = np.linalg.norm(self.sketch, axis=1, keepdims=True)
        self.sketch /= np.where(norm > 0, norm, 1)
        self.lists = {}
        self.width = len(items.weights)
        self.skipped = self.visited = 0

    def entries(self, rows):
        return _ranges(self.at[rows], self.at[rows + 1])

    def blocks(self, place):
        if place not in self.lists:
            self.lists[place] = Blocks(self, self.posted[self.first[place]:self.first[place + 1]])
        return self.lists[place]

    def search(self, wanted, repeats, best, top):
        """`best` (sorted (-score, id is NULL, id)) improved by this shard's documents for one item."""
        place = np.searchsorted(self.names, wanted)
        place[place == len(self.names)] = 0
        here = self.names[place] == wanted if len(self.names) else np.zeros(len(wanted), bool)
        wanted, repeats, place = wanted[here], repeats[here], place[here]
        most = repeats * self.peak[place]
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]
        query = np.zeros(self.width, np.int64)
        query[wanted] = repeats
        seen = np.zeros(self.n, bool)

        def least():
            return -best[-1][0] if len(best) == top else 1

        for n, at in enumerate(order.tolist()):
            if rest[n] < least():
                break
            blocks = self.blocks(int(place[at]))
            bounds = blocks.bounds(wanted, repeats)
            todo = np.argsort(-bounds, kind="stable")
            while len(todo):
                todo = todo[bounds[todo] >= least()]
                some, todo = todo[:4], todo[4:]
                self.visited += len(some)
                rows = blocks.members(some)
                rows = rows[~seen[rows]]
                if len(rows):
                    seen[rows] = True
                    best = self.better(rows, query, best, top, least())
            self.skipped += int((bounds < least()).sum())
        return best

    def better(self, rows, query, best, top, least):
        index, sizes = self.entries(rows)
        score = np.add.reduceat(query[self.term[index]] * self.value[index], np.cumsum(sizes) - sizes)
        good = np.nonzero(score >= least)[0]
        if len(good) > top:
            good = good[score[good] >= np.partition(score[good], -top)[-top]]
        ids = self.ids
        found = [(-s, ids[r] is None, ids[r] or 0) for s, r in zip(score[good].tolist(), rows[good].tolist())]
        return sorted(best + found)[:top]


def _search(shared, top):
    def run(batches):
        items, best = shared.value, {}
        names = pa.array(items.names, pa.binary())
        held, size = [], 0

        def settle():
            ids = [i for part in held for i in part[0]]
            sizes = np.concatenate([part[1] for part in held])
            shifts = np.cumsum([0] + [len(part[1]) for part in held])
            rows = np.concatenate([part[2] + s for part, s in zip(held, shifts)])
            shard = Shard(items, ids, sizes, rows, *(np.concatenate([part[i] for part in held]) for i in (3, 4)))
            for key, wanted, repeats in items.items:
                best[key] = shard.search(wanted, repeats, best.get(key, []), top)

        for batch in batches:
            listed, counts = batch.column("terms"), batch.column("counts")
            number = pc.index_in(listed.flatten().cast(pa.binary()), value_set=names)
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy())
            known = pc.is_valid(number).to_numpy(zero_copy_only=False)
            term = pc.fill_null(number, 0).to_numpy().astype(np.int64)[known]
            count = counts.flatten().to_numpy()[known]
            held.append((batch.column("doc_id").to_pylist(), batch.column("n").to_numpy(), owner[known], term, count))
            size += len(term)
            if size >= SHARD_POSTINGS:
                settle()
                held, size = [], 0
        if held:
            settle()
        rows = [(key, None if null else i, -s) for key, kept in best.items() for s, null, i in kept]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "doc_id", "score"])

    return run


def _first(found, keys, top):
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rank(docs, items, top=TOP, block_bytes=BLOCK_BYTES):
    """(item_id, rank, doc_id, score): the `top` highest-scoring rows of `docs` for each item, best first, score above 0.

    Terms are runs of 0-9, A-Z, a-z and non-ASCII, only A-Z lower-cased.  Equal scores go by ascending doc_id (NULL last).
    NULL, empty and term-less texts score nothing and do not count as documents; an item without terms, or whose terms no
    document has, has no rows.  Items are the distinct (item_id, text): rows that repeat an item count once, different texts
    under one id are ranked each.  Repeated rows of `docs` are documents each.  Empty tables give an empty result.  A very long text
    is one value of its task and is read whole.  Of `docs` only doc_id and text are read, of `items` item_id and text.
    """
    spark = docs.sparkSession
    items = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    items = cut(items.distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    asked = items.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(_item_terms, "key long, term binary")
    asked = cut(asked.groupBy("key", "term").agg(F.count("*").alias("n")), "asked")
    wanted = let_through(asked.select("term").distinct().select(F.xxhash64("term").alias("hash")), "hash")
    forward = cut(text_pairs(docs).mapInArrow(_forward(wanted), _FORWARD), "forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = cut(asked.select("term").distinct().join(df, "term"), "stats")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    found = None
    for block in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block)
        # About block_bytes of item text, and the statistics of its terms.
        some = Items(
            [tuple(r) for r in part.collect()],
            [tuple(r) for r in stats.join(part.select("term").distinct(), "term", "left_semi").collect()], n_docs, n_terms,
        )
        rows = forward.mapInArrow(_search(spark.sparkContext.broadcast(some), top), _FOUND)
        found = rows if found is None else found.unionByName(rows)
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
    ranked = _first(_first(found, ["key", "part"], top).drop("rank"), ["key"], top)
    return ranked.join(items.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
