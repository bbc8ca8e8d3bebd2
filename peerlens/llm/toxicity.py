"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

1. Examples are distinct labelled texts, a bounded sample per class.  Terms whose occurrence goes with the label
   (log-likelihood ratio over the sample) are the vocabulary; one more term stands for all other words, so that an insult
   in ten words and one in a thousand are different directions.  Term frequencies count by their logarithm.
2. One pass turns every document into counts of these terms; document frequencies are counted over all documents.
3. The index lists per term the examples that have it, in blocks of similar examples, with each block's largest weight.
   A query bounds every block by these maxima, visits its few most promising blocks, and then only those whose
   bound is not below its k-th best cosine so far: the neighbours are exact.  Queries go through a block together.
4. The neighbours vote with weights that fall with their distance and undo the unequal sampling of the classes.  Votes of
   the examples themselves, each without itself, calibrate the score (isotonic).  The nearest examples are the evidence.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, cut, text_digest, text_pairs

#: Distinct labelled texts that are drawn of each class: the bound of the training sample.
PER_CLASS = 2048
#: Log-likelihood ratio (one degree of freedom, p = 0.001) and examples from which a term counts, and most terms kept.
ASSOCIATION, LEAST, TERMS = 10.83, 3, 1024
NEIGHBOURS, BLOCK, EVIDENCE = 8, 32, 3
#: Blocks that a query visits before it skips any, and queries that go through the index together.
FIRST, TOGETHER = 4, 256
#: Distance at which a vote has half the weight of a vote at distance zero.
HALF = 0.05
_MARGIN = 1e-9
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_VECTORS = "doc_id long, terms array<int>, counts array<long>"
_SCORED = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:double>>"


def words(raw):
    """Lower-cased words of a text in UTF-8."""
    return raw.decode("utf-8", "replace").lower().encode().translate(_WORD).split()


def _counts(raw):
    held = {}
    for w in words(raw):
        held[w] = held.get(w, 0) + 1
    return held


def _example_terms(batches):
    for batch in byte_slices(batches, "text"):
        names, labels = [], []
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found = _counts(text.as_py())
            names += found
            labels += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(labels, pa.bool_())], ["term", "toxic"])


def _vectors(shared):
    """Counts of the vocabulary's terms per row; the last number stands for all other words."""

    def run(batches):
        vocabulary = shared.value
        for batch in byte_slices(batches, "text"):
            terms, counts = [], []
            for text in batch.column("text"):
                found, other = {}, 0
                for w in words(text.as_py()):
                    at = vocabulary.get(w)
                    if at is None:
                        other += 1
                    else:
                        found[at] = found.get(at, 0) + 1
                if other:
                    found[len(vocabulary)] = other
                terms.append(sorted(found))
                counts.append([found[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "terms", "counts"],
            )

    return run


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5))


def examples(docs, labels, per_class=PER_CLASS):
    """(distinct labelled texts drawn: doc_id, text, share of label 1, toxic, and their numbers per class before drawing).

    Rows whose crc32(doc_id) mod 5 is 0, or whose label is neither 0 nor 1, teach nothing.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))
    marked = marked.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(_fold() != 0)
    marked = marked.groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_digest(), F.lit("")).alias("digest"))
    texts = rows.join(marked, "doc_id").groupBy("digest").agg(F.avg("share").alias("share"), F.min("doc_id").alias("first"))
    texts = cut(texts.withColumn("toxic", F.col("share") >= 0.5), "labelled")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}  # two rows
    drawn = texts.filter("toxic").orderBy(F.xxhash64("digest"), "digest").limit(per_class)
    drawn = drawn.unionByName(texts.filter("NOT toxic").orderBy(F.xxhash64("digest"), "digest").limit(per_class))
    drawn = cut(drawn, "drawn")
    whole = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(text_digest(), F.lit("")).alias("digest"))
    # Broadcast: at most two times per_class digests.
    whole = whole.join(F.broadcast(drawn.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    found = whole.join(F.broadcast(drawn), "digest").select(F.col("first").alias("doc_id"), "text", "share", "toxic")
    return cut(found, "examples"), sizes


def _entropy(a, b):
    return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)


def vocabulary(drawn, association=ASSOCIATION, limit=TERMS):
    """Terms of the examples whose occurrence depends on the label, most telling first; at most `limit`."""
    n = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    with_label, without = float(n.get(True, 0)), float(n.get(False, 0))
    if not with_label or not without:
        return []
    total = with_label + without
    seen = drawn.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "toxic").mapInArrow(
        _example_terms, "term binary, toxic boolean"
    )
    seen = seen.groupBy("term").agg(
        F.count_if("toxic").cast("double").alias("a"), F.count_if(~F.col("toxic")).cast("double").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    c, d = with_label - a, without - b
    ratio = 2 * (
        _entropy(a, with_label * (a + b) / total) + _entropy(b, without * (a + b) / total)
        + _entropy(c, with_label * (c + d) / total) + _entropy(d, without * (c + d) / total)
    )
    chosen = seen.filter(a + b >= LEAST).select("term", ratio.alias("g")).filter(F.col("g") >= association)
    return [bytes(r.term) for r in chosen.orderBy(F.desc("g"), "term").limit(limit).collect()]


def _isotonic(x, y, w):
    """Points (x, y) of the best non-decreasing fit of y on x."""
    order = np.argsort(x, kind="stable")
    pools = []
    for at, value, weight in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([value * weight, weight, at * weight])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _split(dense, rows):
    """`rows` ordered so that neighbours in the order are similar: halves along the main axis, again and again."""
    done, todo = [], [rows]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        some = dense[part] - dense[part].mean(axis=0)
        axis = some[int(np.argmax((some * some).sum(axis=1)))]
        for _ in range(8):
            axis = some.T @ (some @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        half = -(-len(part) // 2 // BLOCK) * BLOCK
        order = part[np.argsort(some @ axis, kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(done) if done else rows


class Index:
    """Examples as unit vectors of TF-IDF weights in a block-max inverted index."""

    def __init__(self, rows, idf, sizes, neighbours=NEIGHBOURS):
        """`rows` (doc_id, terms, counts, share); `sizes` examples per class (True, False) before drawing."""
        self.idf, self.k = idf, neighbours
        rows = sorted(rows, key=lambda r: (r[0], list(r[1]), list(r[2])))
        vectors = [self.unit(np.array(t, np.int64), np.array(c, np.int64)) for _, t, c, _ in rows]
        dense = np.zeros((len(rows), len(idf)), np.float32)
        for i, (t, v) in enumerate(vectors):
            dense[i, t] = v
        order = _split(dense, np.arange(len(rows)))
        self.ids = [rows[i][0] for i in order]
        self.share = np.array([rows[i][3] for i in order], float)
        toxic = self.share >= 0.5
        drawn = {c: max(int((toxic == c).sum()), 1) for c in (True, False)}
        self.weight = np.where(toxic, sizes.get(True, 0) / drawn[True], sizes.get(False, 0) / drawn[False])
        self.prior = round(float((self.weight * self.share).sum() / self.weight.sum()), 9) if len(rows) else 0.0
        term = np.concatenate([vectors[i][0] for i in order]) if rows else np.zeros(0, np.int64)
        value = np.concatenate([vectors[i][1] for i in order]) if rows else np.zeros(0)
        place = np.repeat(np.arange(len(rows)), [len(vectors[i][0]) for i in order]) if rows else np.zeros(0, np.int64)
        by_term = np.argsort(term, kind="stable")
        self.place, self.value, term = place[by_term], value[by_term], term[by_term]
        self.blocks = -(-len(rows) // BLOCK)
        # Where the postings of (term, block) begin, and their largest weight.
        self.at = np.searchsorted(term * self.blocks + self.place // BLOCK, np.arange(len(idf) * self.blocks + 1))
        self.largest = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.largest, (term, self.place // BLOCK), self.value)
        self.visited = 0
        self.points = self._lists = None
        if rows:
            votes = []
            for at in range(0, len(rows), TOGETHER):
                some = order[at:at + TOGETHER]
                queries = np.zeros((len(some), len(idf)))
                for n, i in enumerate(some):
                    queries[n, vectors[i][0]] = vectors[i][1]
                votes.append(self.votes(self.cosines(queries, np.arange(at, at + len(some)))))
            self.points = _isotonic(np.concatenate(votes), self.share, self.weight)

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    @property
    def lists(self):
        """The posting lists, block after block, written out: a row per term."""
        if self._lists is None:
            self._lists = np.zeros((len(self.idf), self.blocks * BLOCK))
            self._lists[np.repeat(np.arange(len(self.idf)), np.diff(self.at[:: max(self.blocks, 1)])), self.place] = self.value
        return self._lists

    def unit(self, terms, counts):
        value = (1 + np.log(counts)) * self.idf[terms]
        return terms, value / max(float(np.sqrt((value * value).sum())), 1e-300)

    def units(self, owner, terms, counts, n):
        """`n` unit vectors as rows, from (owner, term, count) entries."""
        out = np.zeros((n, len(self.idf)))
        out[owner, terms] = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def cosines(self, queries, leave=None):
        """Cosines (row per query, column per place), -1 where a block was skipped; `leave[i]` is not for query i to see."""
        n, width = len(queries), self.blocks * BLOCK
        found = np.full((n, max(width, self.k)), -1.0)
        bound = queries @ self.largest
        rows = np.arange(n)[:, None]
        wanted = np.zeros((n, self.blocks), bool)
        wanted[rows, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]] = True
        done = np.zeros_like(wanted)
        for _ in range(2):
            wanted &= (bound > 0) & ~done
            for block in np.nonzero(wanted.any(axis=0))[0].tolist():
                some = np.nonzero(wanted[:, block])[0]
                span = slice(block * BLOCK, (block + 1) * BLOCK)
                found[some, span] = queries[some] @ self.lists[:, span]
                self.visited += len(some)
            done |= wanted
            if leave is not None:
                found[rows[:, 0], leave] = -1
            wanted = bound >= self.least(found)[:, None] - _MARGIN
        return found

    def least(self, cosines):
        """The k-th largest cosine of each row, zero if there are fewer."""
        return np.maximum(np.partition(cosines, -self.k, axis=1)[:, -self.k], 0)

    def near(self, cosines):
        """Which places are neighbours: the k nearest and all that tie with the last of them; cosine zero is none."""
        return (cosines >= self.least(cosines)[:, None] - _MARGIN) & (cosines > _MARGIN)

    def votes(self, cosines):
        """Weighted share of label 1 among the neighbours; without neighbours the share of all texts."""
        n = len(self.share)
        weight = np.where(self.near(cosines)[:, :n], self.weight / (1 + (1 - np.minimum(cosines[:, :n], 1)) / HALF), 0)
        total = weight.sum(axis=1)
        return np.where(total > 0, weight @ self.share / np.where(total > 0, total, 1), self.prior)

    def neighbours(self, terms, value, leave=None):
        """(places, cosines) of one query's neighbours, nearest first."""
        query = np.zeros((1, len(self.idf)))
        query[0, terms] = value
        cosines = self.cosines(query, None if leave is None else np.array([leave]))
        places = np.nonzero(self.near(cosines)[0])[0]
        order = np.lexsort((places, -np.round(cosines[0, places], 9)))
        return places[order], np.minimum(cosines[0, places[order]], 1.0)

    def scores(self, queries):
        """(calibrated score, evidence) of each query."""
        if self.points is None:
            return [(0.0, [])] * len(queries)
        cosines = self.cosines(queries)
        some = self.near(cosines)
        score = np.where(some.any(axis=1), np.clip(np.interp(self.votes(cosines), *self.points), 0, 1), self.prior)
        shown = np.where(some, np.round(np.minimum(cosines, 1), 9), 0)
        rows, evidence = np.arange(len(queries)), [[] for _ in queries]
        for _ in range(min(EVIDENCE, shown.shape[1])):
            best = shown.argmax(axis=1)
            for i, p, c in zip(range(len(queries)), best.tolist(), shown[rows, best].tolist()):
                if c > 0:
                    evidence[i].append({"doc_id": self.ids[p], "similarity": c, "label": float(self.share[p])})
            shown[rows, best] = 0
        return list(zip(np.round(score, 9).tolist(), evidence))

    def score(self, terms, counts):
        """(calibrated score, evidence) of one vector of counts."""
        return self.scores(self.units(np.zeros(len(terms), np.int64), terms, counts, 1))[0]


def _score(shared):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.float64())]))

    def run(batches):
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                listed, n = batch.column("terms"), batch.num_rows
                owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(listed), 0).to_numpy())
                terms, counts = listed.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
                found = index.scores(index.units(owner, terms, counts, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], kind)],
                    ["doc_id", "score", "evidence"],
                )

    return run


def toxicity(docs, labels, per_class=PER_CLASS, neighbours=NEIGHBOURS):
    """Per row of `docs`: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), evidence (nearest labelled texts).

    Labels of rows with crc32(doc_id) mod 5 = 0 (`held_out`; a NULL id is not) are never used; a score is a function of the
    text alone.  NULL counts as empty.  A text without words has the share of label 1 among the labelled texts as its score.
    Copies are one example, whose label is the mean of theirs; contradicting label rows of one id are averaged; examples
    whose cosine ties with the last neighbour's all vote.  Without usable labels every score is 0.  Repeated rows are
    answered each; an empty table gives an empty result; a very long text is one value of its task and is read whole.
    Of `docs` only doc_id and text are read, of `labels` doc_id and toxic.
    """
    spark = docs.sparkSession
    drawn, sizes = examples(docs, labels, per_class)
    names = vocabulary(drawn)
    numbers = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})  # at most TERMS terms
    vectors = cut(text_pairs(docs).mapInArrow(_vectors(numbers), _VECTORS), "vectors")
    total = vectors.count()
    df = np.zeros(len(names) + 1)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most TERMS + 1 rows
        df[term] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    # At most two times per_class examples of at most TERMS + 1 terms.
    sample = drawn.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text", "share")
    sample = cut(sample, "sample")
    parts = sample.select(F.col("n").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = parts.mapInArrow(_vectors(numbers), _VECTORS).withColumnRenamed("doc_id", "n")
    rows = parts.join(sample.select("n", "doc_id", "share"), "n").select("doc_id", "terms", "counts", "share").collect()
    index = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], idf, sizes, neighbours))
    found = vectors.mapInArrow(_score(index), _SCORED)
    return found.select(
        "doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
    )
