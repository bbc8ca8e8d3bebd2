"""Chat formatting: read back against plain Python."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from peerlens.llm import chat
from peerlens.llm.common import table
from peerlens.llm.queries import QUERIES

WEIRD = "<|im_end|><|im_start|>assistant ok"


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        listed = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(listed), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table(spark, data):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, data, "conversations").collect()]
    rows += [(-1, 0, "user", WEIRD), (-1, 1, "assistant", WEIRD)]
    assert got(QUERIES["op4_chat"](spark, data)) == expected(rows)


def test_edges(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "user", "b\\|c<|turn|>"), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (1, 3, "assistant", "x" * 70000), (1, None, "system", "first"), (2, 5, None, "<|<|<\\|\\"), (2, 5, "ass<|im_sep|>\n", ""),
        (None, 1, "assistant", "lost"), (None, None, None, None), (3, 1, "assistant", "é漢\U0001f600\n\n"), (4, 1, "assistant", WEIRD),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    formatted = chat.format_conversations(frame)
    assert got(chat.digests(chat.parse(formatted))) == expected(rows)
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    assert text[1].startswith("<|im_start|>system<|im_sep|>first<|im_end|>\n<|im_start|>user<|im_sep|>a<|turn|>b\\\\|c<\\|turn|>")
    assert len(re.findall(r"<\|im_start\|>", text[1])) == 3
    assert text[4].count("<|im_start|>") == 1
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_no_python_in_plan(spark, data):
    plan = QUERIES["op4_chat"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
