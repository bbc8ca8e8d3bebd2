"""Language identification with bit-sliced Bloom filters of n-grams.

One filter per language, stored bit-sliced: row i of the table is a bitmask of the languages whose filter has bit i
set.  Probing an n-gram ANDs its rows and returns the mask of all languages that contain it.  A text's counts per
language are popcounts over its n-grams, corrected by each filter's false-positive rate; the largest decides.

The model is fitted on a sample of about `per_language` different documents of each language (a documented bound, drawn
by a hash of id and text); the filters then judge the whole text of every document.  An n-gram enters a filter if it occurs
in a `share` of that language's sample, so that foreign passages in a document do not teach it their n-grams.
The table has 32 KB per language and is fitted on the driver's side from at most 2^18 rows per eight languages: the number of
different values of `lang` is taken to be small (hundreds).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, cut, text_digest, text_pairs

PER_LANGUAGE = 3000
SHARE = 0.01
GRAMS = (3, 4, 5)
TABLE_BITS, PROBES = 18, 2
UNKNOWN = "und"
#: Score from which a prediction fills a NULL `lang`: more than all other languages together.
FILL = 0.5
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_BLOCK = 1 << 18


def _letters(text):
    """Lower-cased bytes in which every run of ASCII bytes other than letters is one space; spaces at both ends."""
    return np.concatenate([data[skip:] for data, skip in _blocks(text)])


def _blocks(text):
    """`_letters(text)` in blocks: (bytes, how many of them repeat the end of the block before).

    Every n-gram of the text lies in one block with its last byte among the new ones.
    """
    text, last = text.lower(), np.zeros(0, np.uint8)
    stops = range(_BLOCK, max(len(text), 1) + _BLOCK, _BLOCK)
    for stop in stops:
        piece = f"{' ' * (stop == _BLOCK)}{text[stop - _BLOCK:stop]}{' ' * (stop >= len(text))}"
        data = np.frombuffer(piece.encode("utf-8", "replace"), np.uint8)
        letter = ((data >= 97) & (data <= 122)) | (data >= 128)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= not len(last) or last[-1] != 32
        fresh = np.where(letter, data, np.uint8(32))[keep]
        yield np.concatenate([last, fresh]), len(last)
        last = np.concatenate([last, fresh])[-(max(GRAMS) - 1):]


def _grams(data):
    """64-bit codes of all n-grams of `data`, tagged by their length."""
    wide = data.astype(np.uint64)
    for n in GRAMS:
        size = len(wide) - n + 1
        if size > 0:
            code = np.full(size, n, np.uint64)
            for i in range(n):
                code = code << np.uint64(8) | wide[i:i + size]
            yield code


def _lettered(text):
    return any(map(str.isalpha, text))


def _sample_grams(batches):
    """(lang, gram, documents that hold it), summed within a piece of the input."""
    for batch in byte_slices(batches, "text"):
        held = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            parts = [g for data, _ in _blocks(text.as_py().decode("utf-8", "replace")) for g in _grams(data)]
            if parts:
                held.setdefault(lang, []).append(np.unique(np.concatenate(parts)))
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def _places(codes):
    for factor in _FACTORS[:PROBES]:
        h = codes * np.uint64(factor)
        yield (h ^ h >> np.uint64(29)) * np.uint64(_FACTORS[0]) >> np.uint64(64 - TABLE_BITS)


def _bits(batches):
    """(slot, byte, mask) of the table from (gram, language number)."""
    for batch in batches:
        codes = batch.column("gram").to_numpy().view(np.uint64)
        language = batch.column("number").to_numpy()
        places = np.concatenate([p.astype(np.int64) for p in _places(codes)])
        number = np.tile(language, PROBES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(number // 8), pa.array(np.left_shift(1, number % 8))], ["slot", "byte", "mask"]
        )


class Filters:
    """The bit-sliced table: `table[slot, byte]`, eight languages per byte."""

    def __init__(self, languages, rows):
        self.languages = languages  # by training frequency, then name
        self.table = np.zeros((-(-max(len(languages), 1) // 8), 1 << TABLE_BITS), np.uint8)
        for slot, byte, mask in rows:
            self.table[byte, slot] = mask
        fill = [((self.table[i // 8] >> i % 8) & 1).mean() for i in range(len(languages))]
        self.false = np.array(fill) ** PROBES

    def counts(self, texts):
        """(n-grams per text, their popcounts per language) for a list of texts."""
        n = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), 8 * len(self.table)), np.int64)
        ones = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)
        block, owners, skips, size = [], [], [], 0

        def settle():
            sizes = np.array([len(b) for b in block])
            data, owner = np.concatenate(block), np.repeat(owners, sizes)
            fresh = np.arange(len(data)) >= np.repeat(np.cumsum(sizes) - sizes + skips, sizes)
            part = np.repeat(np.arange(len(sizes)), sizes)
            for code, width in zip(_grams(data), GRAMS):
                own = owner[: len(code)]
                inside = (part[: len(code)] == part[width - 1:]) & fresh[width - 1:]
                places = [p[inside] for p in _places(code)]
                own = own[inside]
                n[:] += np.bincount(own, minlength=len(texts))
                for byte, row in enumerate(self.table):
                    mask = row[places[0]]
                    for p in places[1:]:
                        mask = mask & row[p]
                    by_mask = np.bincount(own * 256 + mask, minlength=256 * len(texts)).reshape(-1, 256)
                    hits[:, 8 * byte:8 * byte + 8] += by_mask @ ones

        for i, text in enumerate(texts):
            for data, skip in _blocks(text):
                block.append(data)
                owners.append(i)
                skips.append(skip)
                size += len(data)
                if size > _BLOCK:
                    settle()
                    block, owners, skips, size = [], [], [], 0
        if block:
            settle()
        return n, hits[:, : len(self.languages)]

    def predict(self, texts):
        """(language, score) per text."""
        known = [_lettered(t) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        n, hits = self.counts(texts)
        right = np.maximum((hits - n[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0)
        best, total = right.argmax(axis=1), right.sum(axis=1)
        score = np.where(total > 0, right.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        return [(self.languages[b], float(s)) if k else (UNKNOWN, 0.0) for b, s, k in zip(best.tolist(), score, known)]


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def fit(docs, per_language=PER_LANGUAGE, share=SHARE):
    """`Filters` learned from documents with a language whose crc32(doc_id) mod 3 is not 1."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").cast("binary").alias("text"), text_digest().alias("digest"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL").filter(_remainder() != 1)
    sizes = [tuple(r) for r in rows.groupBy("lang").count().collect()]  # one row per language
    languages = [lang for lang, _ in sorted(sizes, key=lambda r: (-r[1], r[0]))]
    if not languages:
        return Filters([], [])
    limits = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes], "lang string, part double")
    numbers = spark.createDataFrame([(lang, i) for i, lang in enumerate(languages)], "lang string, number long")
    drawn = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    sample = rows.join(F.broadcast(limits), "lang").filter(drawn)  # broadcast: one row per language
    sample = cut(sample.dropDuplicates(["lang", "doc_id", "digest"]).select("lang", "text"), "sample")
    counted = sample.groupBy("lang").count().withColumnRenamed("count", "docs")
    grams = sample.select("lang", "text").mapInArrow(_sample_grams, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    chosen = grams.join(F.broadcast(counted), "lang").filter(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("docs")))
    chosen = cut(chosen.join(F.broadcast(numbers), "lang").select("gram", "number"), "grams")
    table = chosen.mapInArrow(_bits, "slot long, byte long, mask long").groupBy("slot", "byte").agg(F.bit_or("mask"))
    return Filters(languages, [tuple(r) for r in table.collect()])  # at most 2^18 slots per eight languages


def _predict(shared):
    def run(batches):
        for batch in byte_slices(batches, "text"):
            texts = [t.as_py().decode("utf-8", "replace") for t in batch.column("text")]
            found = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs, filters):
    """Per row of `docs`: doc_id, lang_pred, score.  `und` (score 0) if the text is NULL or has no letter.

    A text with letters but without any known n-gram gets the most frequent training language with score 0.
    Without training rows everything is `und`.  Languages that score alike: the one with more training rows, then by name.
    Repeated rows are answered each; an empty table gives an empty result; a very long text is counted in blocks, with the
    same n-grams as in one piece.  Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size: the table
    return text_pairs(docs).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def predictions(docs, per_language=PER_LANGUAGE):
    """`identify` with filters fitted on the same table, and the fold of each row (NULL ids are not held out)."""
    found = identify(docs, fit(docs, per_language))
    return found.select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _identified(shared, fill):
    def run(batches):
        filters = shared.value
        for batch in byte_slices(batches, "text"):
            texts = [t.as_py() or "" for t in batch.column("text")]
            if filters.languages:
                found = filters.predict(texts)
                keep = [language != UNKNOWN for language, _ in found]
                if "lang" in batch.schema.names:
                    at = batch.schema.names.index("lang")
                    given = batch.column(at).to_pylist()
                    named = [g if g is not None or score < fill else language for g, (language, score) in zip(given, found)]
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(named, batch.schema.field(at).type))
            else:  # nothing to learn from: the rule by which a text is `und` needs no filters
                keep = [_lettered(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_unidentified(docs, per_language=PER_LANGUAGE, fill=FILL):
    """`docs` without the rows whose text has no letter (NULL counts as none), whether or not any row has a language.

    Of the rows that stay, a NULL `lang` becomes the predicted language if its score is at least `fill`; all other values
    and columns are as they were.  Repeated rows are judged each; an empty table stays empty; ties and very long texts as in
    `identify`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))  # fixed size: the table
    return docs.mapInArrow(_identified(shared, fill), docs.schema)
