"""Chat formatting as relational work: sorted turn structs, adjacent turns of one role merged, Spark expressions only.

    <|im_start|>role<|im_sep|>text<|turn|>text<|im_end|>\\n

A block holds the adjacent turns of one role; `<|turn|>` marks where one turn ends inside it, so merging loses
nothing.  In roles and texts a backslash is doubled and `<|` becomes `<\\|`; no control string can then occur in
them, and both steps are undone exactly.  The loss mask is a list of (start, length) in code points of the formatted
text, one per assistant turn.

A conversation is one text, hence one row; its turns meet in one group by definition of the result.
"""

from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|turn|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text):
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text):
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _merge(acc, turn):
    """One more turn on a list of blocks (role, texts)."""
    last = F.element_at(acc, -1)
    joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
    alone = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == turn["role"])
    return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
        F.concat(acc, F.array(alone))
    )


def _loss(acc, block):
    """Position after one more block, and the spans of its texts if they are to be learned."""
    head = acc["at"] + len(START) + F.char_length(block["role"]) + len(SEP)
    begin = F.struct(head.cast("int").alias("at"), acc["spans"].alias("spans"))

    def text(state, t):
        span = F.struct(state["at"].alias("start"), F.char_length(t).alias("length"))
        spans = F.when(block["role"] == LOSS_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.char_length(t) + len(TURN)).cast("int").alias("at"), spans.alias("spans"))

    after = F.aggregate(block["texts"], begin, text)
    return F.struct(
        (after["at"] - len(TURN) + len(END) + 1).cast("int").alias("at"), after["spans"].alias("spans")
    )


def format_conversations(conversations):
    """(conv_id, formatted, loss_spans) per conversation.

    Turns are ordered by (turn, role, text), NULL turns first; NULL roles and texts count as empty; repeated rows are
    turns of their own; rows without conv_id form one conversation.  An empty table gives no rows; other
    columns are not read.  The text of a conversation is bounded by Spark's 2 GB for one value.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    merged = rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.aggregate("turns", none, _merge).alias("blocks")
    )
    escaped = merged.select(
        "conv_id",
        F.transform(
            "blocks",
            lambda b: F.struct(escape(b["role"]).alias("role"), F.transform(b["texts"], escape).alias("texts")),
        ).alias("blocks"),
    )
    block = lambda b: F.concat(
        F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], TURN), F.lit(END + "\n")
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return escaped.select(
        "conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"),
        F.aggregate("blocks", begin, _loss)["spans"].alias("loss_spans"),
    )


def _quoted(mark):
    return mark.replace("|", r"\|")


def parse(formatted):
    """(conv_id, formatted, turns (role, text), learned): what `format_conversations` wrote, read back."""
    def block(b):
        role = F.substring_index(b, SEP, 1)
        rest = F.substr(b, F.char_length(role) + len(SEP) + 1)
        texts = F.split(F.substring_index(rest, END, 1), _quoted(TURN))
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    blocks = F.split("formatted", _quoted(START))
    learned = lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    return formatted.select(
        "conv_id", "formatted",
        F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block)).alias("turns"),
        F.array_join(F.transform("loss_spans", learned), "").alias("learned"),
    )


def digests(parsed):
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
