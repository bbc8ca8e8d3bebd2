"""Burrows-Wheeler transforms of string shards, merged by interleave refinement.

The strings are pieces of bytes, read in wide symbols: a symbol is a block of WIDTH bytes, and each of the WIDTH phases of a
piece is one string, so every byte position starts a suffix.  Strings are cut at symbols that are met once, since no repeated
interval holds such a symbol, and runs too short for a repeat are left out.  A shard's suffixes are sorted once, alone.  Shards are
merged without comparing suffixes: starting from "all of shard 0, then all of shard 1, ...", each round moves every
entry to where its preceding symbol sends it (the LF step), which sorts the interleave by one more symbol.  A boundary
that first shows in round h separates suffixes with h - 1 common symbols; entries that no round has
separated are repeated intervals of that many symbols.
"""

import numpy as np

from peerlens.llm.anchors import SPAN, gram_hashes

WIDTH = 40
DEPTH = SPAN // WIDTH


def _starts(lengths):
    return np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _order(key):
    """Stable argsort of numbers from 0; key and index are sorted as one number where both fit."""
    bits = len(key).bit_length()
    if int(key.max()) >> 63 - bits:
        return np.argsort(key, kind="stable")
    packed = key << bits | np.arange(len(key))
    packed.sort()
    return packed & (1 << bits) - 1


class Symbols:
    """Dense symbol ids of the suffix positions of a list of pieces, string by string, checked on the bytes.

    With `part`, strings are cut at symbols that are met once, and runs below DEPTH symbols are left out: neither holds
    anything of a repeated interval of DEPTH symbols.
    """

    def __init__(self, pieces, part=False):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.base = _starts(self.lengths)
        data = np.frombuffer(b"".join(pieces) + bytes(WIDTH), np.uint8)
        step = 1 << 18
        h = np.concatenate([gram_hashes(data[at:at + step + WIDTH - 1], WIDTH) for at in range(0, len(data) - WIDTH + 1, step)])
        # A suffix position leaves room for one whole symbol.
        phase = np.arange(WIDTH)
        count = (np.maximum(self.lengths[:, None] - phase, 0) // WIDTH).ravel()
        self.string = np.repeat(np.arange(len(count)), count)
        self.place = np.repeat((self.base[:, None] + phase).ravel() - WIDTH * _starts(count), count) + WIDTH * np.arange(count.sum())
        self.piece = self.string // WIDTH
        h = h[self.place]
        if part:
            # Slots of hashes first: a symbol alone in its slot is met once.
            shift = np.uint64(63 - len(h).bit_length())
            h = self._reduced(h, lambda h: (h >> shift).astype(np.int64))
        self.ids = self._numbered(data, h)
        if part:
            self.ids = self._reduced(self.ids, lambda ids: ids)

    def _reduced(self, values, symbols):
        """Cut by the counts of `symbols(values)` for as long as that leaves out over a tenth; the values that stay."""
        while True:
            kept = self._cut(symbols(values))
            done, values = len(kept) >= 0.9 * len(values), values[kept]
            if done:
                return values

    def _cut(self, symbols):
        """Leave out what no repeated interval can hold, judged by the counts of `symbols`; the indices that stay."""
        if not len(symbols):
            return symbols
        again = np.bincount(symbols)[symbols] > 1
        fresh = ~again
        fresh[1:] |= self.string[1:] != self.string[:-1]
        run = np.cumsum(fresh)
        kept = np.nonzero(again & (np.bincount(run[again], minlength=run[-1] + 1) >= DEPTH)[run])[0]
        self.place, self.piece, self.string = self.place[kept], self.piece[kept], run[kept]
        return kept

    def _numbered(self, data, h):
        order = np.argsort(h)
        sorted_ = h[order]
        same = sorted_[1:] == sorted_[:-1]
        words = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
        at = self.place[order]
        for i in range(0, WIDTH, 8):
            w = words[at + i]
            if (same & (w[1:] != w[:-1])).any():  # two blocks of one hash: order by the bytes themselves
                rows = np.lib.stride_tricks.as_strided(data, (len(data) - WIDTH + 1, WIDTH), (1, 1))[self.place]
                _, ids = np.unique(np.ascontiguousarray(rows).view(f"V{WIDTH}").ravel(), return_inverse=True)
                return ids.ravel().astype(np.int64) + 1
        ids = np.empty(len(h), np.int64)
        if len(h):
            ids[order] = np.concatenate([[1], 1 + np.cumsum(~same)])
        return ids


class Shard:
    """Sorted suffixes of the strings of the pieces low..high and what precedes each; one end mark per string comes first."""

    def __init__(self, symbols, low, high):
        inside = slice(*np.searchsorted(symbols.piece, [low, high]))
        ids, place, string = symbols.ids[inside], symbols.place[inside], symbols.string[inside]
        n = len(ids)
        first = np.ones(n, bool)
        first[1:] = string[1:] != string[:-1]
        heads = np.nonzero(first)[0]
        marks = len(heads)
        lengths = np.diff(heads, append=n)
        # Suffixes of the same string from each one on.
        left = np.repeat(heads + lengths, lengths) - np.arange(n)
        rank, reach = ids, 1
        longest = int(lengths.max())
        while True:
            follow = np.zeros(n, np.int64)
            follow[:-reach] = np.where(left[:-reach] > reach, rank[reach:], 0)
            key = rank * (int(rank.max()) + 1) + follow
            order = _order(key)
            key = key[order]
            new = key[1:] != key[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[1], 1 + np.cumsum(new)])
            reach *= 2
            if new.all() or reach >= longest:
                break
        self.places = np.concatenate([np.full(marks, -1), place[order]])
        before = np.zeros(n, np.int64)
        before[1:] = np.where(first[1:], 0, ids[:-1])
        self.symbols = np.concatenate([ids[heads + lengths - 1], before[order]])
        self.marks = marks
        # LF: the entry that an entry's preceding suffix is; strings' first suffixes (symbol 0) lead nowhere.
        by = _order(self.symbols)
        self.step = np.full(len(self.symbols), -1, np.int64)
        self.step[by[marks:]] = marks + np.arange(n)


def merge(shards, depth=DEPTH):
    """(entries in merged order as (place or -1), block numbers, common symbols with the entry before, at most `depth`)."""
    sizes = [len(s.symbols) for s in shards]
    base = np.concatenate([[0], np.cumsum(sizes)])
    symbol = np.concatenate([s.symbols for s in shards]) << 32
    step = np.concatenate([s.step + b for s, b in zip(shards, base)])
    marks = np.concatenate([np.arange(s.marks) + b for s, b in zip(shards, base)])
    n, m = int(base[-1]), len(marks)
    source, block = np.arange(n), np.zeros(n, np.int64)
    common = np.full(n, -1, np.int8)
    common[0] = 0
    line, low = np.arange(n), (1 << 32) - 1
    for h in range(1, depth + 1):
        key = symbol[source] | line
        key.sort()
        key = key[m:]  # as many entries precede a first suffix as there are strings; their places hold the end marks
        order, value = key & low, key >> 32
        inner = block[order]
        fresh = np.ones(n, bool)
        fresh[m + 1:] = (value[1:] != value[:-1]) | (inner[1:] != inner[:-1])
        source = np.concatenate([marks, step[source[order]]])
        block = np.cumsum(fresh)
        common[fresh & (common < 0)] = h - 1
    common[common < 0] = depth
    places = np.concatenate([s.places for s in shards])[source]
    return places, block, common


def repeated_starts(pieces, shard_bytes=1 << 18):
    """For a list of different pieces: per piece the offsets at which a SPAN-byte string starts that also starts elsewhere."""
    symbols = Symbols(pieces, part=True)
    if not len(symbols.ids):
        return [np.zeros(0, np.int64) for _ in pieces]
    # Shards are cut between pieces that have suffixes left.
    held, sizes = np.unique(symbols.piece, return_counts=True)
    shards, low, sums = [], 0, np.cumsum(sizes)
    while low < len(held):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + shard_bytes, side="right")))
        shards.append(Shard(symbols, held[low], held[high - 1] + 1))
        low = high
    places, _, common = merge(shards)
    whole = common >= DEPTH
    hit = whole.copy()
    hit[:-1] |= whole[1:]
    found = np.sort(places[hit])
    piece = np.searchsorted(symbols.base, found, side="right") - 1
    cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
    return [found[a:b] - symbols.base[i] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
