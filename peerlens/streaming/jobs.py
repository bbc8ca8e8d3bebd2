"""Structured Streaming jobs.

All state is Spark's own: groupings in update mode for the folds, de-duplication and windows, and
`transformWithState` (`ordered`) where events of a peer have to be taken in order.
"""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens import domains as D
from peerlens.operators import connections, distributions, folds, normalise
from peerlens.plans.policy import DEFAULT_POLICY
from peerlens.session import run_dir
from peerlens.sources import bridge, sinks
from peerlens.streaming import ordered

# Declared schema of the event files.
EVENT_FILE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark, directory, files_per_batch=None, pattern="events*.parquet"):
    """The event log as a stream of files."""
    reader = spark.readStream.schema(EVENT_FILE).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return bridge.events(reader.parquet(directory))


def run_to_end(stream, path, mode="append", fmt="parquet"):
    """Process everything that is available into files at `path`."""
    query = (
        stream.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", path + "-progress")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return path


def run_batches(stream, path, handle, trigger=None, mode="append"):
    """Run `handle(df, batch_id)` for every micro-batch until the input ends."""
    writer = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", path + "-progress")
        .trigger(**(trigger or {"availableNow": True}))
    )
    query = writer.start()
    if trigger is None:
        query.awaitTermination()
    return query


# ------------------------------------------------------------ stateless


def gossip_stream(events, kind, self_id, genesis=D.MAINNET_GENESIS):
    """Gossip rows of one kind; the batch projection applied to a stream."""
    return normalise.gossip_to_rows(bridge.messages(events), kind, self_id, genesis)


def timed_attestation_stream(attestations, peers):
    """Stream-static enrichment with the sender's peer row."""
    return sinks.timed_attestations(attestations, peers)


def publish_timed(attestations, peers, path, trigger=None):
    """Published events of every micro-batch, each enriched by way of its distinct senders.

    Give `peers` as `tables.bucketed(peers, "peer_id")`: then no batch moves it.  A repeated batch replaces itself.
    """

    def handle(batch, batch_id):
        events = sinks.attestation_event_json(sinks.timed_attestations(batch, peers))
        events.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return run_batches(attestations, path, handle, trigger)


def attestation_event_stream(attestations, peers):
    return sinks.attestation_event_json(timed_attestation_stream(attestations, peers))


# ------------------------------------------------------------ built-in state


def dedup_gossip(rows, within=None):
    """First copy of every message.

    The default remembers every id (as the table's key does).  `within` bounds
    the state: ids are forgotten that long after the watermark.
    """
    rows = rows.filter(F.col("slot") != 0)
    if within is None:
        return rows.dropDuplicates(["msg_id"])
    return rows.withWatermark("arrival_time", within).dropDuplicatesWithinWatermark(["msg_id"])


#: Slots of a date's bitmap over message ids (512 KB), in the pieces that Spark's bitmap functions build.
ID_SLOTS = 1 << 22


def _slots(rows):
    """(date, bucket, position) of message ids in the bitmaps of their dates."""
    slot = F.pmod(F.xxhash64("msg_id"), F.lit(ID_SLOTS))
    return rows.withColumns({"bucket": F.bitmap_bucket_number(slot), "position": F.bitmap_bit_position(slot)})


def dedup_table(rows, path, trigger=None):
    """Keep a message table in which every id occurs once, for ever, without state: the first by arrival of the batch that
    brings an id.

    Every arrival date of the table has a bitmap over its ids; a batch meets the bitmaps by slot, and only the dates that
    may hold one of its ids are read for the exact anti-join.  Rows go to `path`/rows, bitmaps to `path`/bitmaps; a
    repeated batch replaces its own.
    """
    spark = rows.sparkSession
    fresh = rows.filter(F.col("slot") != 0).withColumn("date", F.to_date("arrival_time").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType()), T.StructField("date", T.StringType())])
    places = {part: os.path.join(path, part) for part in ("rows", "bitmaps")}
    bitmap_schema = "bucket long, bits binary, batch long, date string"

    def handle(batch, batch_id):
        first = F.min_by(F.struct(*[c for c in batch.columns if c != "msg_id"]), F.struct("arrival_time", "seq")).alias("r")
        batch = batch.groupBy("msg_id").agg(first).select("msg_id", "r.*").persist()
        if batch_id:
            stored = spark.read.schema(schema).parquet(places["rows"]).filter(F.col("batch") < batch_id)
            bitmaps = spark.read.schema(bitmap_schema).parquet(places["bitmaps"]).filter(F.col("batch") < batch_id)
            byte = F.conv(F.hex(F.substring("bits", (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.pow(F.lit(2), F.col("position") % 8).cast("int")
            met = _slots(batch.drop("date")).join(bitmaps, "bucket").filter(byte.bitwiseAND(bit) != 0)
            dates = [r.date for r in met.select("date").distinct().collect()]  # at most one row per date
            old = stored.filter(F.col("date").isin(dates)).select("msg_id")
            out = batch.join(old, "msg_id", "left_anti")
        else:
            out = batch
        out = out.persist()
        bits = _slots(out).groupBy("date", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        for part, df in (("rows", out), ("bitmaps", bits)):
            df.write.mode("overwrite").partitionBy("date").parquet(os.path.join(places[part], f"batch={batch_id}"))
        out.unpersist()
        batch.unpersist()

    query = run_batches(fresh, path, handle, trigger)
    return query, lambda: spark.read.schema(schema).parquet(places["rows"]).drop("batch", "date")


def message_rates(messages, tick=D.METRIC_TICK, late="1 minute"):
    """Messages per topic and closed window."""
    return distributions.messages_per_topic(messages.withWatermark("arrival_time", late), tick)


def topic_senders(messages, every="1 hour", late="1 minute", precision=12):
    """Sketches of the senders per topic and closed window; `distributions.united_senders` rolls them up to any range."""
    return distributions.sender_sketches(messages.withWatermark("arrival_time", late), every, precision)


# ------------------------------------------------------------ event-time processors


def _timed(rows, late, **more):
    """Rows with their time as a number, behind a watermark."""
    return rows.withColumn("us", F.unix_micros("ts")).withColumns(more).withWatermark("ts", late)


def _process(rows, processor, out):
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    return rows.groupBy("peer_id").transformWithState(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def pair_conn_stream(halves, late="1 hour", orphan_after=None):
    """Connection events from a stream of halves, in any order within `late`.

    A pair comes out once the watermark has passed its close.  `orphan_after` seconds of event time drop an open
    that has no close; without it, it waits.
    """
    pairs = _process(_timed(halves, late), ordered.Pairs(orphan_after), ordered.Pairs.out)
    pairs = pairs.withColumns({"opened": F.timestamp_micros("us"), "closed": F.timestamp_micros("close_us")})
    return connections.conn_event_rows(pairs, "opened", "closed")


def _dials(hosts, attempts, late, policy, emit, forget_after=None):
    found = hosts.select("peer_id", "ts", "seq", F.lit(True).alias("found"))
    tried = attempts.select(
        "peer_id", "ts", "seq", F.lit(False).alias("found"), (F.col("status") == "positive").alias("positive"),
        policy.class_of(F.col("error")).alias("kind"), "error",
    )
    rows = _timed(found.unionByName(tried, allowMissingColumns=True), late)
    return _process(rows, ordered.Dials(policy, emit, forget_after), ordered.Dials.outs[emit])


def live_attempt_stream(hosts, attempts, late="1 hour", policy=DEFAULT_POLICY):
    """Attempts inside a life, with its number and whether they end it."""
    rows = _dials(hosts, attempts, late, policy, "attempts")
    return rows.select(
        "peer_id", F.timestamp_micros("us").alias("ts"), "seq", F.when(F.col("positive"), "positive").otherwise("negative").alias("status"),
        "error", "life", "deprecable",
    )


def retry_state_stream(hosts, attempts, late="1 hour", policy=DEFAULT_POLICY, forget_after=None):
    """The retry state of every peer whose state changed; the last row of a peer is its state."""
    rows = _dials(hosts, attempts, late, policy, "state", forget_after)
    return rows.select(
        "peer_id", F.col("life").cast("int").alias("life"), F.timestamp_micros("start_us").alias("life_start"),
        F.col("kind").alias("delay_class"), "degree", F.timestamp_micros("last_us").alias("last_attempt"),
        F.timestamp_micros("next_us").alias("next_attempt"), "deprecable", F.col("error").alias("last_error"),
    )


def due_stream(hosts, attempts, late="1 hour", policy=DEFAULT_POLICY):
    """Peers as their next attempt comes due on the event clock, each turn once; new peers at their discovery."""
    rows = _dials(hosts, attempts, late, policy, "due")
    return rows.select(
        "peer_id", F.col("life").cast("int").alias("life"), F.timestamp_micros("due_us").alias("due"),
        F.col("kind").alias("delay_class"), "degree",
    )


def late_rows(query):
    """Rows that came behind the watermark and were left out, over the batches of a query's progress."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


# ------------------------------------------------------------ folds


def keep_folded(rows, path, trigger=None):
    """Run a streaming fold (a grouping in update mode) into `path`: a folder of changed rows per micro-batch.

    The state is Spark's; a batch that is repeated after a failure replaces its own folder, so the table is the same.
    """

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return run_batches(rows, path, handle, trigger, "update")


def folded(spark, path, schema, *keys):
    """The table that `keep_folded` has written so far: of every key the row of its latest batch."""
    columns = [f.name for f in schema.fields if f.name not in keys]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


def fold_to_end(rows, path, *keys):
    """`keep_folded` over everything that is available; the table."""
    keep_folded(rows, path)
    return folded(rows.sparkSession, path, rows.schema, *keys)


def fold_peer_stream(hosts, answers, attempts, halves, path, late="1 hour", policy=DEFAULT_POLICY):
    """The peer table over everything that is available, from streams of its four logs.

    Lives and pairs need a peer's events in order and are settled first, into files; the table itself is the batch
    fold as one grouping in update mode over those files and the other two logs, so a peer with very many events
    is combined on the map side.
    """
    spark = hosts.sparkSession
    parts = {"attempts": live_attempt_stream(hosts, attempts, late, policy), "pairs": pair_conn_stream(halves, late)}
    for name, part in parts.items():
        run_to_end(part, os.path.join(path, name))
    live, paired = (spark.readStream.schema(part.schema).parquet(os.path.join(path, name)) for name, part in parts.items())
    return fold_to_end(folds.fold_peer_state(hosts, answers, live, paired), os.path.join(path, "peers"), "peer_id")


# ------------------------------------------------------------ ticks


def metrics_tick(clock, path, build, tick=D.METRIC_TICK, trigger=None):
    """Append a metrics snapshot per trigger; `build(batch)` returns the long rows."""

    def handle(batch, batch_id):
        rows = build(batch).withColumn("tick", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(os.path.join(path, f"tick={batch_id}"))

    return run_batches(clock, path, handle, trigger)


def live_trigger(interval=D.METRIC_TICK):
    """Trigger of a continuously running tick."""
    return {"processingTime": interval}


def snapshot_tick(clock, path, peers, as_of, trigger=None):
    """Append an active-peers snapshot per trigger, the first at the start, stamped `as_of(batch_id)`.

    `snapshot_trigger()` is the trigger of a job that runs on.
    """

    def handle(batch, batch_id):
        rows = folds.active_peers_snapshot(peers(), as_of(batch_id))
        rows.write.mode("overwrite").parquet(os.path.join(path, f"tick={batch_id}"))

    return run_batches(clock, path, handle, trigger)


def snapshot_trigger():
    return live_trigger(D.SNAPSHOT_TICK)


def stream_path(spark, name):
    return run_dir(spark, name)
