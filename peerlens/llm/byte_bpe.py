"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string's prefix ends in exactly one token.  `PrefixEncoder` stores that last token for every
prefix: token t can end prefix i if its bytes do, and if the pair (last token of prefix i - len(t), t) survives
merging, i.e. encodes to itself.  Appending bytes extends the table and changes nothing before; after an edit the
table is recomputed until it agrees with the old one over the length of the longest token, from where it is copied.
"""

import base64
import functools
import re
from array import array
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, text_pairs

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
_CACHE, _MEMO = 250_000, 400_000
_PIECE = 1 << 20
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def _latin_pattern():
    """The same split for texts within Latin-1, with the classes spelled out for the faster `re`."""
    every = [chr(i) for i in range(256)]
    classes = {name: "".join(re.escape(c) for c in every if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    letter, number, space = classes.values()
    # Every alternative begins with characters of its own, so letters may be tried first.
    return re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


_LATIN = _latin_pattern()


class Vocabulary:
    """Ranks of a tiktoken file; the path must exist on every worker, as the libraries do."""

    def __init__(self, path):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.longest = max(self.sizes)
        # The two halves of a token's last merge; a token that its own bytes do not give has none and is left out.
        self.halves, self.finder = {}, ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merge(token, 2)
                if len(parts) != 2 or self.tokens[parts[0]] + self.tokens[parts[1]] not in self.ranks or self.merge(token) != [rank]:
                    continue
                self.halves[rank] = tuple(parts)
            self.finder.add_word(token.decode("latin-1"), rank)
        self.finder.make_automaton()
        self._pairs = {}

    def merge(self, data, least=1):
        """Reference merging of a short string down to `least` parts: the lowest rank first, the leftmost of equals."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > least:
            ranked = [(self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 40:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def pair(self, a, b):
        """Whether two adjacent tokens stay as they are."""
        key = a << 20 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= _MEMO:
                self._pairs.clear()
            found = self._pairs[key] = self._stays(a, b)
        return found

    def _stays(self, a, b):
        """Undo the merges of both sides from the last to the first, looking for one across the border that came sooner.

        `before` is the rank that a merge across must be below: that of the merge just undone, or equal to
        it where the border's merge would stand further left.
        """
        before, ranks, tokens, halves = 1 << 40, self.ranks, self.tokens, self.halves
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < before:
                return False
            if a in halves and (a > b or b not in halves):
                before, a = a, halves[a][1]
            elif b in halves:
                before, b = b + 1, halves[b][0]
            else:
                return True


def last_tokens(v, data):
    """The last token of every prefix of `data`."""
    last, done, sizes, known, pair = [None], 0, v.sizes, v._pairs.get, v.pair
    add = last.append
    for at, token in v.finder.iter(data.decode("latin-1")):
        if at < done:
            continue
        begin = at + 1 - sizes[token]
        if begin:
            before = last[begin]
            stays = known(before << 20 | token)
            if not stays and (stays is False or not pair(before, token)):
                continue
        add(token)
        done += 1
    return last


class PrefixEncoder:
    """The encoding of every prefix of a byte string: `last[i]` is the last token of the first i bytes."""

    def __init__(self, vocabulary, data=b""):
        self.vocabulary, self.data, self.last = vocabulary, data, last_tokens(vocabulary, data)

    def _extend(self, begin, until=None):
        """Fill the table from prefix `begin` on; `until(end)` may end it early."""
        v, last = self.vocabulary, self.last
        sizes, pairs, pair = v.sizes, v._pairs, v.pair
        # A token that ends beyond `begin` starts at most `longest` bytes before.
        low = max(0, begin - v.longest)
        text = self.data[low:].decode("latin-1")
        done = begin
        for at, token in v.finder.iter(text):
            end = low + at + 1
            if end <= done:
                continue
            if end > done + 1:
                raise ValueError("the vocabulary lacks a byte")
            before = last[end - sizes[token]]
            if before is not None:
                stays = pairs.get(before << 20 | token)
                if not (pair(before, token) if stays is None else stays):
                    continue
            elif end > sizes[token]:
                continue
            last.append(token)
            done = end
            if until and until(end):
                return

    def append(self, data):
        start = len(self.data)
        self.data += data
        self._extend(start)

    def edit(self, at, removed, inserted):
        """Replace `removed` bytes at `at`; gives how many table entries had to be computed."""
        old, tail = self.last, at + removed
        shift = len(inserted) - removed
        self.data = self.data[:at] + inserted + self.data[tail:]
        self.last = old[: at + 1]
        same = 0

        def agrees(end):
            nonlocal same
            before = end - shift
            same = same + 1 if before > tail and old[before] == self.last[end] else 0
            return same >= self.vocabulary.longest

        self._extend(at, agrees)
        computed = len(self.last) - at - 1
        self.last += old[len(self.last) - shift:]
        return computed

    def tokens(self, end=None):
        """Token ids of the first `end` bytes (all by default)."""
        end, out, sizes = len(self.data) if end is None else end, [], self.vocabulary.sizes
        while end:
            out.append(self.last[end])
            end -= sizes[out[-1]]
        return out[::-1]


class _Words(dict):
    """Ids (as 32-bit numbers in a row) per piece of text; a bounded memo, since pieces repeat."""

    def __init__(self, vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word):
        if len(self) >= _CACHE:
            self.clear()
        data = word.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else PrefixEncoder(self.vocabulary, data).tokens()
        packed = array("i", ids).tobytes()
        if len(word) <= 64:
            self[word] = packed
        return packed


_LOADED = {}


def _loaded(path):
    if path not in _LOADED:
        vocabulary = Vocabulary(path)
        _LOADED[path] = vocabulary, _Words(vocabulary), pa.array(vocabulary.tokens, pa.binary())
    return _LOADED[path]


def forget(path=VOCABULARY):
    """Empty the memos that go with a vocabulary; the vocabulary stays."""
    if path in _LOADED:
        vocabulary, words, _ = _LOADED[path]
        words.clear()
        vocabulary._pairs.clear()


@functools.cache
def _other_classes():
    """Code points that the splitting library of tiktoken classes otherwise than `regex` does (other Unicode versions).

    They are mapped to a stand-in of the class that counts; gives (pattern that finds them, mapping).
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    stand_in, seen = dict.fromkeys(every, "\ufffe"), {"\ufffe": set(every)}
    own = {}
    for name, sign in ((r"\p{L}", "\u00e9"), (r"\p{N}", "\u00b2"), (r"\s", "\u2003")):
        single = {bytes([i]): i for i in range(256)}
        finder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        stand_in |= dict.fromkeys(bytes(finder.encode_ordinary(every)).decode(), sign)
        own |= dict.fromkeys(regex.findall(name, every), sign)
    differ = {c: sign for c, sign in stand_in.items() if own.get(c, "\ufffe") != sign}
    pattern = regex.compile("[" + "".join(map(regex.escape, differ)) + "]") if differ else None
    return pattern, str.maketrans(differ)


def _matches(text):
    """The pieces of a text that are encoded separately, in order."""
    split = _LATIN
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        split, (pattern, mapping) = _SPLIT, _other_classes()
        if pattern and pattern.search(text):
            return (text[m.start():m.end()] for m in _SPLIT.finditer(text.translate(mapping)))
    return split.findall(text) if len(text) <= _PIECE else (m.group() for m in split.finditer(text))


def _split(text):
    found = _matches(text)
    if isinstance(found, list):
        yield found
        return
    while words := list(islice(found, 1 << 16)):
        yield words


def encode_text(text, path=VOCABULARY):
    """Token ids of a text without special tokens."""
    words = _loaded(path)[1]
    return np.frombuffer(b"".join(b"".join(map(words.__getitem__, w)) for w in _split(text)), np.int32)


def _encode(path):
    def run(batches):
        for batch in byte_slices(batches, "text", 1 << 20):
            ids = [encode_text(t.as_py().decode("utf-8", "replace"), path) for t in batch.column("text")]
            offsets = np.cumsum([0] + [len(x) for x in ids])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])
        forget(path)  # a worker that waits for other tasks holds no memos

    return run


def _decode(path):
    def run(batches):
        tokens = _loaded(path)[2]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # The tokens of all rows in a row: each text is a stretch of their bytes.
                lists = part.column("ids")
                flat = tokens.take(lists.flatten())
                stops = np.cumsum([0] + lists.value_lengths().fill_null(0).to_pylist())
                ends = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
                whole = pa.Array.from_buffers(
                    pa.binary(), len(lists), [None, pa.py_buffer(ends[stops].astype(np.int32).tobytes()), flat.buffers()[2] or pa.py_buffer(b"")]
                )
                texts = pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return run


def encode(docs, path=VOCABULARY):
    """Per row of `docs`: doc_id, ids (array).

    NULL counts as empty and has no ids.  Repeated rows are encoded each; an empty table gives an empty result; a very long
    text is split and encoded piece after piece, as one value of its task; other columns are not read.
    """
    return text_pairs(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded, path=VOCABULARY):
    """`encoded` (doc_id, ids) with the bytes `decoded`; NULL ids give NULL."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, decoded binary")


def encode_and_decode(docs, path=VOCABULARY):
    """`decode(encode(docs))` in one pass, so that ids need not travel between two workers."""
    def run(batches):
        return _decode(path)(_encode(path)(batches))

    return text_pairs(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded):
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
