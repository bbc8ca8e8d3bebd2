"""Topic handlers: a topic family mapped to a row projection."""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.functions import gossip


@dataclass(frozen=True)
class Handler:
    """How one topic family becomes rows.

    `matches(pretty_topic)` selects messages, `problem()` gives a reason to
    reject an otherwise accepted message (NULL means fine) and `columns()` the
    columns that only this family has.
    """

    matches: Callable[[Column], Column]
    problem: Callable[[], Column]
    columns: Callable[[], list]


DEFAULT_HANDLERS = {
    "attestation": Handler(
        matches=lambda pretty: pretty.startswith(D.ATTESTATION_PREFIX),
        problem=lambda: F.when(
            gossip.topic_subnet(F.col("topic")).isNull(), F.lit("no subnet in topic")
        ),
        columns=lambda: [
            gossip.topic_subnet(F.col("topic")).alias("subnet"),
            F.lit("").alias("val_pubkey"),
        ],
    ),
    "block": Handler(
        matches=lambda pretty: pretty == D.BLOCK_TOPIC,
        problem=lambda: F.lit(None).cast("string"),
        columns=lambda: [F.col("proposer").cast("long").alias("val_idx")],
    ),
}


def with_handler(name, handler, handlers=None):
    """The handler set with one more (or a replaced) family."""
    return {**(handlers or DEFAULT_HANDLERS), name: handler}
