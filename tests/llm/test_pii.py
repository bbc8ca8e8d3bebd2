"""Personal data: base spans against the patterns as written, the field against labelled rows it has not seen."""

import hashlib
import random
import re

import pytest

from peerlens.llm import pii
from peerlens.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    checks = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if checks[k](m.group())] for k, p in PATTERNS.items()}


def test_base_spans_on_random_texts():
    rng = random.Random(2)
    for alphabet in ("a@.b1-", "12.5 ", "0123 -", "+1 ().-2", "a1@.+- (%é\n4"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == brute(text), text


def test_whole_table(spark, data):
    docs = table(spark, data, "documents")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for d in docs.collect():
        base, got = brute(d.text), rows[d.doc_id]
        assert [got[f"n_{k}"] for k in PATTERNS] == [len(base[k]) for k in PATTERNS]
        listed = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in base[k]]
        assert got.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got.spans.split(",")) | {""}


def test_field_on_unseen_rows():
    model, rows = pii.trained(), pii.labelled_table(400, seed=99)
    guessed = model.decode([pii._features(w) for w, _ in rows])
    assert sum(g == y for g, (_, y) in zip(guessed, rows)) / len(rows) > 0.95


def test_field_adds_what_patterns_miss():
    texts = ["please call (555) 123-4567 now", "nothing here", "host 10.1.2.3:8080 is up"]
    bases = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(pii.trained(), texts, bases)
    assert [(k, texts[0][a:b]) for k, a, b in added[0]] == [("phone", "(555) 123-4567")]
    assert added[1] == added[2] == []


def test_viterbi_equals_all_paths():
    from itertools import product

    import numpy as np

    from peerlens.llm.crf import Chain

    rng = np.random.default_rng(1)
    chain = Chain(3)
    chain.emit, chain.step, chain.begin = rng.normal(size=chain.emit.shape), rng.normal(size=(3, 3)), rng.normal(size=3)
    tokens = [[[int(x) for x in rng.integers(0, 99, 4)] for _ in range(n)] for n in (1, 5, 0, 3, 5)]
    for path, words in zip(chain.decode(tokens, batch=2), tokens):
        emit = chain.scores(words)
        score = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + (chain.begin[p[0]] + sum(chain.step[a, b] for a, b in zip(p, p[1:])) if p else 0)
        assert path == list(max(product(range(3), repeat=len(words)), key=score))


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "@" * 100_000, "+1" * 100_000, "1." * 150_000, "a.a@" * 80_000, " " * 300_000 + "7"])
def test_long_runs_take_linear_time(text):
    base = pii.base_spans(text)
    pii.added_spans(pii.trained(), [text], [base])


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a@b.co", None), (3, "\U0001f600 1.2.3.4", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.personal_data(docs).collect()
    assert sorted((r.spans for r in out)) == ["", "", "", "email:0:6", "ip:2:9"]
    assert pii.personal_data(docs.limit(0)).count() == 0
    assert sorted(str(r.text) for r in pii.mask(docs).collect()) == ["", "", "<email>", "None", "\U0001f600 <ip>"]
    assert pii.mask(docs).columns == docs.columns


def test_field_reads_all_words():
    plain = " ".join("the quick brown fox jumps over it".split() * 300)
    texts = ["write to john(at)example.com today", f"{plain} mail: john(at)example.com or visit us {plain}", f"{'x' * 200}/9876 {plain}"]
    added = pii.added_spans(pii.trained(), texts, [pii.base_spans(t) for t in texts])
    assert [[(k, t[a:b]) for k, a, b in spans] for t, spans in zip(texts, added)] == [[("email", "john(at)example.com")]] * 2 + [[]]


def test_scores_by_word_equal_features():
    import numpy as np

    model = pii.trained()
    words = "Ab ab.c x@y.z +1 (555) a(at)b.com 漢字 12.3.4.5:80 don't WORLD é, < > the the".split()
    assert np.allclose(pii.Words(model).score(["<", *words, ">"]), model.scores(pii._features(words)), atol=1e-3)


def test_decoding_is_viterbi_over_the_whole_text():
    """Splitting at words that can only be "none" gives the labels of one chain over all words."""
    rng = random.Random(4)
    model = pii.trained()
    table = [" ".join(w) for w, _ in pii.labelled_table(120, seed=9)]
    texts = ["", "one", "12", " ".join(table), "a@b.c " * 700, "4 " * 900, "call (555) 123-4567" + " 8" * 400 + " now"]
    texts += [" ".join(rng.choices(table + ["the and of it"] * 40, k=rng.randint(1, 120))) for _ in range(25)]
    for text, found in zip(texts, pii._decoded(model, texts)):
        words = text.split()
        path = model.paths(pii.Words(model).score(["<", *words, ">"]), [len(words)])[0] if words else []
        assert found == [(n, label) for n, label in enumerate(path) if label]


def test_features_read_whole_words():
    """What lies behind the first characters of a long word counts."""
    long = "x" * 70
    assert pii._shape("A" + long + "1") != pii._shape("A" + long + "-")
    assert pii._low(long + "a") != pii._low(long + "b")
    assert pii._numbers(long + "12") != pii._numbers(long + "ab")
    assert pii._shape("Ab-12345678:é") == "Xx-dddd:x" and pii._shape("..--") == ".-" and pii._shape("abc") == "x"
