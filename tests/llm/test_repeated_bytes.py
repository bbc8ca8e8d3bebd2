"""Repeated byte strings against a count of all windows, and the BWT merge alone."""

import hashlib
import random
from collections import Counter

import pytest

from peerlens.llm import anchors, bwt, repeated_bytes
from peerlens.llm.common import table

SPAN = anchors.SPAN


def brute(texts):
    met = Counter(hash(t[i:i + SPAN]) for t in texts for i in range(len(t) - SPAN + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - SPAN + 1):
            if met[hash(t[i:i + SPAN])] > 1:
                gone[i:i + SPAN] = b"\x01" * SPAN
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in repeated_bytes.remove_repeated(frame, **options).collect())
    expected = brute([(t or "").encode() for _, t, _ in rows])
    assert got == sorted((d if d is not None else -1, *e) for (d, _, _), e in zip(rows, expected))
    return got


def test_whole_table(spark, data):
    got = check(spark, [(r.doc_id, r.text, None) for r in table(spark, data, "documents").collect()])
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("group_bytes", [repeated_bytes.GROUP_BYTES, 3000])
def test_common_passage_in_many_texts(spark, group_bytes):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = word(900)
    rows = [(i, word(rng.randint(0, 700)) + passage[rng.randint(0, 60):rng.randint(840, 900)] + word(rng.randint(0, 700)), "x") for i in range(60)]
    rows += [(100, passage, None), (101, passage, None), (101, passage, None), (102, "ab" * 900, None), (103, "z" * 450, None),
             (104, "q" * 400, None), (105, passage[:399], None), (106, passage[:400], None), (107, None, None), (None, "", None), (None, word(500), None)]
    check(spark, rows, group_bytes=group_bytes)


def test_near_copies(spark):
    rng = random.Random(9)
    base = [rng.choice("abcdefgh ") for _ in range(6000)]
    rows = []
    for i in range(30):
        text = base[:]
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(len(text))] = "#"
        rows.append((i, "".join(text), None))
    check(spark, rows)


def test_empty(spark):
    assert repeated_bytes.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(anchors, "_BLOCK", 1000)
    rng = random.Random(1)
    for raw in (bytes(rng.choice(b"ab ") for _ in range(5000)), b"x" * 1500, b"ab" * 700, b"a" * 399, b"", bytes(rng.choice(b"abcdef") for _ in range(400))):
        hashes, starts, counts, offsets = anchors.pieces(raw)
        covered = [s + i for s, n in zip(starts.tolist(), counts.tolist()) for i in range(n)]
        assert covered == list(range(max(0, len(raw) - SPAN + 1)))
        same = {}
        for h, s, n, o in zip(hashes.tolist(), starts.tolist(), counts.tolist(), offsets.tolist()):
            for i in range(n):
                window = raw[s + i:s + i + SPAN]
                assert same.setdefault(window, (h, o - i)) == (h, o - i)


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 20])
def test_merge_equals_sorting(shard_bytes):
    rng = random.Random(4)
    for letters in (b"abcdefgh ", b"ab"):
        source = bytes(rng.choice(letters) for _ in range(3000))
        some = set()
        for _ in range(40):
            at = rng.randrange(2200)
            piece = bytearray(source[at:at + rng.randint(400, 740)])
            if rng.random() < 0.6:
                piece[rng.randrange(len(piece))] = rng.randrange(256)
            some.add(bytes(piece))
        some = sorted(some, key=hash)
        met = Counter(p[i:i + SPAN] for p in some for i in range(len(p) - SPAN + 1))
        expected = [[i for i in range(len(p) - SPAN + 1) if met[p[i:i + SPAN]] > 1] for p in some]
        assert [x.tolist() for x in bwt.repeated_starts(some, shard_bytes)] == expected


def test_merged_order_and_common_prefixes():
    rng = random.Random(6)
    some = [bytes(rng.choice(b"ab") for _ in range(200)) + b"c" * 240 for _ in range(9)]
    symbols = bwt.Symbols(some)
    shards = [bwt.Shard(symbols, 0, 4), bwt.Shard(symbols, 4, 9)]
    places, block, common = bwt.merge(shards)
    # The order by the first DEPTH symbols, spelled out.
    at = dict(zip(symbols.place.tolist(), symbols.ids.tolist()))
    end = {int(b + n) for b, n in zip(symbols.base, symbols.lengths)}
    owner = dict(zip(symbols.place.tolist(), symbols.piece.tolist()))

    def word(p):
        out, q = [], p
        while q in at and owner[q] == owner[p]:
            out.append(at[q])
            q += bwt.WIDTH
        return out

    entries = [word(p) if p >= 0 else [] for p in places.tolist()]
    inner = [e[: bwt.DEPTH] for e in entries]
    assert inner == sorted(inner)
    for a, b, n in zip(entries, entries[1:], common[1:].tolist()):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert min(same, bwt.DEPTH) == n
    assert end


def test_blocks_of_one_hash_are_told_apart(monkeypatch):
    rng = random.Random(7)
    some = [bytes(rng.choice(b"abc") for _ in range(600)) for _ in range(5)]
    some += [some[0][50:560]]
    expected = [x.tolist() for x in bwt.repeated_starts(some)]
    real = bwt.gram_hashes
    monkeypatch.setattr(bwt, "gram_hashes", lambda data, size: real(data, size) & 7)
    assert [x.tolist() for x in bwt.repeated_starts(some)] == expected


def test_only_what_may_repeat_is_sorted(monkeypatch):
    rng = random.Random(10)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    common, edges = word(380), [word(180) for _ in range(80)]
    apart = [a + common + b for a, b in zip(edges[::2], edges[1::2])]
    repeat = word(400)
    some = apart + [word(150) + repeat + word(100) for _ in range(3)] + [word(30) + repeat[:399] + b"#" + word(9)]
    sorted_entries = []
    real = bwt.merge
    monkeypatch.setattr(bwt, "merge", lambda shards, *depth: sorted_entries.extend(len(s.symbols) for s in shards) or real(shards, *depth))
    assert [x.tolist() for x in bwt.repeated_starts(apart, 5000)] == [[] for _ in apart]
    assert not sorted_entries
    assert [x.tolist() for x in bwt.repeated_starts(some, 5000)] == [[] for _ in apart] + [[150]] * 3 + [[]]
    assert 0 < sum(sorted_entries) < sum(len(p) for p in some) // 10


@pytest.mark.parametrize("top", [1 << 10, 1 << 60])
def test_order_is_stable(top):
    rng = random.Random(11)
    some = [rng.randrange(top) for _ in range(500)]
    key = bwt.np.array([rng.choice(some) for _ in range(5000)], bwt.np.int64)
    assert bwt._order(key).tolist() == sorted(range(len(key)), key=lambda i: (key[i], i))
