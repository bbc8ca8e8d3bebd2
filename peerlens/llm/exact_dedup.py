"""Exact duplicates by Patricia tries that own the strings of a length-and-hash partition.

1. Every row gets the key (bytes, XXH64) of its normalised text, in the JVM; keys of a single row need no trie.
2. Rows of repeated keys go to tasks by key (adaptive execution splits a hot key over several tasks).
   Each task inserts the whole byte strings into a compressed radix trie; a terminal node holds the
   best row so far and a count.  A task hands on one row per different string, however many copies.
3. The owner of a key merges those few rows in a trie again.  A trie beyond its memory bound (labels, nodes and
   values as Python holds them) spills its largest subtree: in step 2 the terminals are handed on early, in step 3
   they go to another round, dealt by one more hash.

Equality is decided by the tries, on the bytes; the digest is only reported.
"""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from peerlens.llm.common import byte_slices, cut, small, text_digest, without

TRIE_BYTES = 48 << 20
#: Memory of a node with its edge, small dict, value and the objects in it, and of one more member of a value.
NODE_BYTES, MEMBER_BYTES = 700, 250

_RAW = "row long, doc_id long, n_chars long, n_bytes long, hash long, sha string, digest string"
_LOCAL = _RAW + ", token long, body binary, size long"
_OWNED = "token long, keep_row long, keep_id long, size long"
_OWNER = _OWNED + ", n_bytes long, hash long, doc_id long, row long, n_chars long, body binary"


class Node:
    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges, self.value = {}, None


class PatriciaTrie:
    """Compressed radix trie over byte strings; labels sit on the edges."""

    def __init__(self):
        self.root, self.bytes, self.nodes, self.terminals, self.members = Node(), 0, 0, 0, 0

    @property
    def memory(self):
        """About what the trie holds: `bytes` of labels, its nodes, and what its values list."""
        return self.bytes + NODE_BYTES * self.nodes + MEMBER_BYTES * self.members

    def node(self, key):
        """The node of `key`, made if absent."""
        at, pos = self.root, 0
        while pos < len(key):
            edge = at.edges.get(key[pos])
            if edge is None:
                child = Node()
                at.edges[key[pos]] = (key[pos:], child)
                self.bytes += len(key) - pos
                self.nodes += 1
                return child
            label, child = edge
            end = pos + len(label)
            if key[pos:end] == label:
                at, pos = child, end
                continue
            same = _common(label, key[pos:end])
            middle = Node()
            self.nodes += 1
            middle.edges[label[same]] = (label[same:], child)
            at.edges[key[pos]] = (label[:same], middle)
            at, pos = middle, pos + same
        return at

    def walk(self, node=None, prefix=b""):
        """(key, node) of every terminal below `node`, without recursion."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, path = stack.pop()
            if at.value is not None:
                yield path, at
            stack += [(child, path + label) for label, child in at.edges.values()]

    def spill(self):
        """Cut the largest subtree below the first branching node; gives its prefix and terminals."""
        at, prefix, parents = self.root, b"", None
        while at.value is None and len(at.edges) == 1:
            (label, at), = at.edges.values()
            prefix += label
        if not at.edges:
            return None, []
        sizes = {}
        for first, (label, child) in at.edges.items():
            total, nodes, stack = len(label), 1, [child]
            while stack:
                node = stack.pop()
                total += sum(len(x) for x, _ in node.edges.values())
                nodes += len(node.edges)
                stack += [x for _, x in node.edges.values()]
            sizes[first] = total + NODE_BYTES * nodes, total, nodes
        first = max(sizes, key=sizes.get)
        label, child = at.edges.pop(first)
        out = list(self.walk(child, prefix + label))
        self.bytes -= sizes[first][1]
        self.nodes -= sizes[first][2]
        self.terminals -= len(out)
        return prefix + bytes([first]), out


def _common(a, b):
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _better(a, b):
    """The row that stays: most code points, smallest id (NULL last), first row."""
    return min(a, b, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))


def _pairs(docs):
    """(doc_id, text, n_bytes, hash): the key of every row, by its normalised text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumns({"n_bytes": F.octet_length(_body()).cast("long"), "hash": F.xxhash64(_body())})


def _body():
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary")


def _marks():
    """Columns of a row's verdict, from `_pairs`."""
    chars = F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")
    return ["doc_id", chars, "n_bytes", "hash", F.sha2(_body(), 256).alias("sha"), text_digest().alias("digest")]


def _rows(names, kinds, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_LOCAL_NAMES = ["row", "doc_id", "n_chars", "n_bytes", "hash", "sha", "digest", "token", "body", "size"]
_LOCAL_KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.binary(), pa.int64()]


def _local_tries(limit):
    """Rows of repeated keys -> a membership row per document, a string row per different text."""

    def run(batches):
        next_id = TaskContext.get().partitionId() << 40
        trie = PatriciaTrie()

        def strings(found):
            for body, node in found:
                token, best, size, key = node.value
                yield (best[2], best[1], best[0], *key, None, None, token, body, size)

        for batch in byte_slices(batches, "body"):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n_chars", "n_bytes", "hash", "sha", "digest")]
            for doc, n, n_bytes, h, sha, digest, value in zip(*columns, batch.column("body")):
                next_id += 1
                node = trie.node(value.as_py())
                if node.value is None:
                    node.value = (next_id, (n, doc, next_id), 1, (n_bytes, h))
                    trie.terminals += 1
                else:
                    token, best, size, key = node.value
                    node.value = (token, _better(best, (n, doc, next_id)), size + 1, key)
                out.append((next_id, doc, n, n_bytes, h, sha, digest, node.value[0], None, None))
                while trie.memory > limit and trie.terminals > 1:
                    out += strings(trie.spill()[1])
            if out:
                yield _rows(_LOCAL_NAMES, _LOCAL_KINDS, out)
        out, held = [], 0
        for row in strings(trie.walk()):
            out.append(row)
            held += len(row[8])
            if held > 4 << 20:
                yield _rows(_LOCAL_NAMES, _LOCAL_KINDS, out)
                out, held = [], 0
        if out:
            yield _rows(_LOCAL_NAMES, _LOCAL_KINDS, out)

    return run


_OWNER_NAMES = ["token", "keep_row", "keep_id", "size", "n_bytes", "hash", "doc_id", "row", "n_chars", "body"]
_OWNER_KINDS = [pa.int64()] * 9 + [pa.binary()]


def _owner_tries(limit):
    """String rows sorted by key -> (token, row that stays), or the row again for another round."""

    def run(batches):
        key, trie, spilled = None, PatriciaTrie(), []

        def settled():
            for _, node in trie.walk():
                best, size, members = node.value
                yield from ((m[0], best[2], best[1], size, None, None, None, None, None, None) for m in members)

        def again(body, n, h, m):
            token, doc, row, chars, size = m
            return (token, None, None, size, n, h, doc, row, chars, body)

        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for doc, row, n_chars, n, h, token, size, value in zip(*columns, batch.column(7)):
                if (n, h) != key:
                    out += settled()
                    key, trie, spilled = (n, h), PatriciaTrie(), []
                body, member = value.as_py(), (token, doc, row, n_chars, size)
                if any(body.startswith(p) for p in spilled):
                    out.append(again(body, n, h, member))
                    continue
                node = trie.node(body)
                if node.value is None:
                    node.value = ((n_chars, doc, row), size, [member])
                    trie.terminals += 1
                else:
                    best, total, members = node.value
                    members.append(member)
                    trie.members += 1
                    node.value = (_better(best, (n_chars, doc, row)), total + size, members)
                while trie.memory > limit and trie.terminals > 1:
                    prefix, found = trie.spill()
                    spilled.append(prefix)
                    for text, gone in found:
                        trie.members -= len(gone.value[2]) - 1
                        out += [again(text, n, h, m) for m in gone.value[2]]
            if out:
                yield _rows(_OWNER_NAMES, _OWNER_KINDS, out)
        out = list(settled())
        if out:
            yield _rows(_OWNER_NAMES, _OWNER_KINDS, out)

    return run


def _verdicts(docs, trie_bytes):
    """`exact_dedup` with the digest of each row's text."""
    pairs = _pairs(docs)
    marks = cut(pairs.select(*_marks()), "marks")
    repeated = cut(marks.groupBy("n_bytes", "hash").count().filter("count > 1").select("n_bytes", "hash"), "keys")
    repeated = small(repeated)
    single = marks.join(repeated, ["n_bytes", "hash"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars", "digest",
    )
    rows = pairs.join(repeated, ["n_bytes", "hash"], "left_semi").select(*_marks(), _body().alias("body"))
    local = cut(rows.mapInArrow(_local_tries(trie_bytes), _LOCAL), "tries")

    open_rows = local.filter("body IS NOT NULL")
    owned, salt = None, 0
    while True:
        dealt = open_rows.select("doc_id", "row", "n_chars", "n_bytes", "hash", "token", "size", "body")
        keys = ["n_bytes", "hash"] + [F.xxhash64("body", F.lit(salt))] * bool(salt)
        merged = cut(
            dealt.repartition(*keys).sortWithinPartitions("n_bytes", "hash").mapInArrow(_owner_tries(trie_bytes), _OWNER),
            "owners",
        )
        settled = merged.filter("body IS NULL").select("token", "keep_row", "keep_id", F.col("size").alias("group_size"))
        owned = settled if owned is None else owned.unionByName(settled)
        open_rows = merged.filter("body IS NOT NULL")
        if open_rows.isEmpty():
            break
        salt += 1
    members = local.filter("body IS NULL").select("doc_id", "row", "n_chars", "sha", "token", "digest")
    copies = members.join(owned, "token").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"), "n_chars", "digest",
    )
    return single.unionByName(copies)


def exact_dedup(docs, trie_bytes=TRIE_BYTES):
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and n_chars).

    Texts are equal when identical without the six white-space characters; of equal texts the row with
    the most code points stays, then the smallest doc_id (NULL last), then one of the repeated rows.
    NULL text counts as empty; empty texts form one group.  An empty table gives an empty result.  A very long text is
    one value of its task.  Other columns of `docs` are not read.
    """
    return _verdicts(docs, trie_bytes).drop("digest")


def drop_exact(docs, trie_bytes=TRIE_BYTES):
    """`docs` without the rows that `exact_dedup` does not keep, all columns as they were, whatever their names.

    Rows that share a doc_id are told apart by their text; of fully repeated rows (id and text) one stays.  NULL and
    empty texts and ties as in `exact_dedup`; an empty table stays empty.
    """
    rows = cut(
        _verdicts(docs, trie_bytes).groupBy("doc_id", "digest").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")), "verdict"
    )
    gone = rows.filter("NOT stays OR n > 1").select("doc_id", "digest")
    left = without(docs, gone)
    repeated = rows.filter("stays AND n > 1")
    if repeated.isEmpty():
        return left
    again = without(docs, repeated.select("doc_id", "digest"), "left_semi")
    again = again.groupBy(F.col("doc_id"), text_digest()).agg(F.first(F.struct("*")).alias("one")).select("one.*")
    return left.unionByName(again)
