"""Streams over several files against the same job in batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from peerlens.operators import connections, distributions, folds, normalise, retry
from peerlens.plans.policy import RetryPolicy
from peerlens.plans.queries import AS_OF, STRICT, Inputs
from peerlens.plans.registry import Tables, metrics_snapshot
from peerlens.sources import bridge, sinks, tables
from peerlens.streaming import jobs


@pytest.fixture(scope="module")
def files(spark, data, tmp_path_factory):
    """The event log in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    log = bridge.table(spark, data, "events")
    for i in range(4):
        log.filter(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture
def stream(spark, files):
    return jobs.event_stream(spark, files, files_per_batch=1, pattern="*.parquet")


@pytest.fixture
def batch(spark, data):
    return Inputs(spark, data)


def rows(df):
    return sorted(df.collect(), key=str)


def paired(stream, path, late):
    """Pairs that a stream gives, and its query."""
    out = jobs.pair_conn_stream(bridge.conn_halves(stream), late)
    query = jobs.run_batches(out, path, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return stream.sparkSession.read.schema(out.schema).parquet(path), query


PAIR_COLUMNS = ["seq", *connections.CONN_EVENT_COLUMNS]


def test_connection_pairs(spark, stream, batch, files, tmp_path):
    got, query = paired(stream, str(tmp_path / "s"), "0 seconds")
    assert rows(got.select(PAIR_COLUMNS)) == rows(batch.conn_events().select(PAIR_COLUMNS))
    assert jobs.late_rows(query) == 0
    # A restart without new files emits nothing again.
    again, _ = paired(jobs.event_stream(spark, files, files_per_batch=1, pattern="*.parquet"), str(tmp_path / "s"), "0 seconds")
    assert again.count() == got.count()


@pytest.fixture
def overlapping(spark, data, tmp_path):
    """The event log in three files that overlap in time."""
    folder = str(tmp_path / "mixed")
    log = bridge.table(spark, data, "events")
    for i in range(3):
        mixed = F.floor((F.col("event_id") + F.col("event_id") % 3 * 20) / 400) == i
        log.filter(mixed).coalesce(1).write.mode("append").parquet(folder)
    return jobs.event_stream(spark, folder, files_per_batch=1, pattern="*.parquet")


def test_connection_pairs_within_the_lateness(overlapping, batch, tmp_path):
    """Mixed-up files give the batch pairs whose close the watermark has passed, and nothing is late."""
    got, query = paired(overlapping, str(tmp_path / "s"), "4 days")
    border = batch.halves.agg(F.max("ts") - F.expr("INTERVAL 4 DAYS")).first()[0]
    wanted = batch.conn_events().filter(F.col("ts") <= F.lit(border))
    assert rows(got.select(PAIR_COLUMNS)) == rows(wanted.select(PAIR_COLUMNS)) and wanted.count() > 50
    assert jobs.late_rows(query) == 0


def test_late_halves_are_counted(spark, data, batch, tmp_path):
    """Halves that come long after their place are left out and counted; the rest is paired as if they had not come."""
    folder = str(tmp_path / "late")
    log = bridge.table(spark, data, "events")
    straggler = F.col("event_id") % 10 == 0
    for i in range(4):
        here = straggler if i == 3 else ~straggler & (F.floor(F.col("event_id") / 334) == i)
        log.filter(here).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.event_stream(spark, folder, files_per_batch=1, pattern="*.parquet")
    got, query = paired(stream, str(tmp_path / "s"), "0 seconds")
    border = batch.halves.filter("seq % 10 <> 0 AND seq < 668").agg(F.max("ts")).first()[0]
    late = batch.halves.filter((F.col("seq") % 10 == 0) & (F.col("ts") <= F.lit(border)))
    assert jobs.late_rows(query) == late.count() > 0
    wanted = connections.pair_conn_events(batch.halves.join(late.select("seq"), "seq", "left_anti"))
    assert rows(got.select(PAIR_COLUMNS)) == rows(wanted.select(PAIR_COLUMNS))


def step_by_step(found, tried, policy):
    """A plain replay of the dial queue: (states after all events, attempts inside lives, turns that came due)."""
    events = sorted([(r.ts, r.seq, True, None, None) for r in found] + [(r.ts, r.seq, False, r.error, r.status == "positive") for r in tried])
    codes = {c: name for name, listed in policy.classes for c in listed}
    life, alive, start, success, cls, degree, last, due = 0, False, None, None, None, 0, None, None
    live, turns = [], []
    for ts, seq, is_found, error, positive in events:
        if alive and due is not None and due <= ts:
            turns.append((life, due, cls or "Minus1", degree))
            due = None
        if is_found:
            if not alive:
                life, alive, start, cls, degree, last, due = life + 1, True, ts, None, 0, None, ts
            continue
        if alive:
            kind = codes.get(error, policy.default_class)
            degree = degree + 1 if kind == cls else 1
            overdue = success is None or (ts - success).total_seconds() >= policy.deprecate_after
            ends = not positive and overdue and (ts - start).total_seconds() >= policy.deprecate_after
            cls, last, alive = kind, ts, not ends
            live.append((ts, seq, life, ends))
            due = None if ends else ts + timedelta(seconds=policy.seconds(kind, degree))
        if positive:
            success = ts
    end = events[-1][0]
    if alive and due is not None and due <= end:
        turns.append((life, due, cls or "Minus1", degree))
    return (life, start, cls or "Minus1", degree, last, not alive), live, turns


@pytest.fixture
def dial_files(spark, tmp_path):
    """A random dial and discovery log of few peers, one with most of the rows, in three files in time order."""
    rng = random.Random(5)
    begin = datetime(2024, 1, 1)
    found, tried = [], []
    times = sorted(rng.sample(range(1, 40 * 86400), 900))
    for seq, at in enumerate(times):
        peer = "hot" if rng.random() < 0.5 else f"p{rng.randint(1, 6)}"
        ts = begin + timedelta(seconds=at)
        if rng.random() < 0.2:
            found.append((peer, ts, seq))
        else:
            error = rng.choice(["none"] + ["io_timeout"] * 6 + ["connection_refused", "no_route_to_host"] * 3)
            tried.append((peer, ts, seq, "positive" if error == "none" else "negative", error))
    hosts = spark.createDataFrame(found, "peer_id string, ts timestamp, seq long")
    attempts = spark.createDataFrame(tried, "peer_id string, ts timestamp, seq long, status string, error string")
    both = hosts.unionByName(attempts, allowMissingColumns=True)
    for low in (0, 300, 600):
        both.filter(F.col("seq").between(low, low + 299)).coalesce(1).write.mode("append").parquet(str(tmp_path / "dials"))
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "dials"))
    return hosts, attempts, stream.filter("status IS NULL").select(*hosts.columns), stream.filter("status IS NOT NULL")


def test_retry_state_and_turns_of_a_stream(spark, dial_files, tmp_path):
    """State, live attempts and due turns are those of a plain replay, and the state is that of the batch."""
    hosts, attempts, found, tried = dial_files
    policy = RetryPolicy(deprecate_after=2 * 86400)
    path = str(tmp_path / "state")
    out = jobs.retry_state_stream(found, tried, "0 seconds", policy)
    jobs.run_batches(out, path, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    changes = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in out.dtypes)}, batch long").parquet(path)
    assert changes.select("batch").distinct().count() >= 3
    state = jobs.folded(spark, path, out.schema, "peer_id")
    assert rows(state) == rows(retry.peer_retry_state(attempts, hosts, policy).select(state.columns))

    live, turns = str(tmp_path / "live"), str(tmp_path / "due")
    jobs.run_to_end(jobs.live_attempt_stream(found, tried, "0 seconds", policy), live)
    jobs.run_to_end(jobs.due_stream(found, tried, "0 seconds", policy), turns)
    live, turns = spark.read.parquet(live).collect(), spark.read.parquet(turns).collect()
    seen, dials = hosts.collect(), attempts.collect()
    ends = 0
    for peer in {r.peer_id for r in seen}:
        final, inside, due = step_by_step([r for r in seen if r.peer_id == peer], [r for r in dials if r.peer_id == peer], policy)
        got = state.filter(F.col("peer_id") == peer).first()
        assert (got.life, got.life_start, got.delay_class, got.degree, got.last_attempt, got.deprecable) == final
        assert sorted((r.ts, r.seq, r.life, r.deprecable) for r in live if r.peer_id == peer) == inside
        mine = sorted((r.life, r.due, r.delay_class, r.degree) for r in turns if r.peer_id == peer)
        last = max(r.ts for r in [*seen, *dials])
        open_turn = {t for t in mine if t not in due}
        assert sorted(due) == [t for t in mine if t in due] and all(t[1] <= last for t in open_turn) and len(open_turn) <= 1
        ends += sum(e for *_, e in inside)
    assert ends > 3


def test_ready_queue_at_every_tick(spark, dial_files, tmp_path):
    """Who has come due and was not dialled since is the batch's ready queue at that moment."""
    hosts, attempts, found, tried = dial_files
    policy = RetryPolicy(deprecate_after=2 * 86400)
    path = str(tmp_path / "due")
    jobs.run_to_end(jobs.due_stream(found, tried, "0 seconds", policy), path)
    turns = spark.read.parquet(path).collect()
    dials = attempts.collect()
    for day in (3, 11, 20, 33):
        now = datetime(2024, 1, 1) + timedelta(days=day)
        waiting = set()
        for t in turns:
            later = [r.ts for r in dials if r.peer_id == t.peer_id and t.due < r.ts <= now]
            if t.due <= now and not later:
                waiting.add(t.peer_id)
        ready = retry.ready_queue(retry.peer_retry_state(attempts, hosts, policy, now), now)
        assert waiting == {r.peer_id for r in ready.collect()}


def test_given_up_peers_and_orphans_are_forgotten(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    at = lambda day: begin + timedelta(days=day)
    log = [("a", at(0), 0, None, None), ("a", at(3), 1, "negative", "io_timeout"), ("b", at(9), 2, None, None),
           ("a", at(10), 3, None, None), ("b", at(11), 4, "positive", "none")]
    folder = str(tmp_path / "log")
    frame = spark.createDataFrame(log, "peer_id string, ts timestamp, seq long, status string, error string")
    for n in range(5):
        frame.filter(F.col("seq") == n).coalesce(1).write.mode("append").parquet(folder)
    policy = RetryPolicy(deprecate_after=2 * 86400)
    lives = {}
    for forget in (None, 86400):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = jobs.retry_state_stream(
            stream.filter("status IS NULL").select("peer_id", "ts", "seq"), stream.filter("status IS NOT NULL"), "0 seconds", policy, forget
        )
        jobs.run_to_end(out, str(tmp_path / f"out{forget}"))
        lives[forget] = spark.read.parquet(str(tmp_path / f"out{forget}")).filter("peer_id = 'a'").agg(F.max("life")).first()[0]
    assert lives == {None: 2, 86400: 1}
    halves = [("a", "open", at(0), 0), ("b", "open", at(5), 1), ("a", "close", at(8), 2), ("b", "close", at(9), 3), ("c", "open", at(20), 4)]
    frame = spark.createDataFrame(
        [(p, k, t, s, 1, 5, True, "None") for p, k, t, s in halves],
        "peer_id string, kind string, ts timestamp, seq long, direction int, latency_ns long, identified boolean, error string",
    )
    folder = str(tmp_path / "halves")
    for n in range(5):
        frame.filter(F.col("seq") == n).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_to_end(jobs.pair_conn_stream(stream, "0 seconds", orphan_after=5 * 86400), str(tmp_path / "pairs"))
    assert [r.peer_id for r in spark.read.parquet(str(tmp_path / "pairs")).collect()] == ["b"]


def peer_table(source, path):
    hosts = normalise.normalise_peers(bridge.discoveries(source))
    answers = normalise.identify_events(bridge.raw_connections(source))[1]
    attempts = normalise.normalise_attempts(bridge.raw_dials(source))
    return jobs.fold_peer_stream(hosts, answers, attempts, bridge.conn_halves(source), path, "0 seconds", STRICT)


def test_batches_equal_one_pass(spark, data, batch, tmp_path):
    """However uneven its micro-batches, the table is that of the whole log: lives, connections and all; a restart
    goes on from what was committed."""
    log, folder = bridge.table(spark, data, "events"), str(tmp_path / "uneven")
    wanted = batch.peer_state(STRICT)
    assert wanted.filter("deprecated").count() > 0
    cuts = (0, 300, 310, 10**9)
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        log.filter(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
        if n:  # the first run sees two files, a restart the third
            got = peer_table(jobs.event_stream(spark, folder, files_per_batch=1, pattern="*.parquet"), str(tmp_path / "p"))
    assert rows(got.select(wanted.columns)) == rows(wanted)


def test_other_tables(spark, stream, batch, tmp_path):
    """Status, attestations and blocks, folded file by file, are the batch folds."""
    status, metadata = normalise.identify_events(bridge.raw_connections(stream))[2:]
    cases = {
        "status": (folds.fold_eth_status(status, metadata), folds.fold_eth_status(*batch.identified()[2:]), "peer_id"),
        "attestations": (
            folds.insert_attestations(jobs.gossip_stream(stream, "attestation", bridge.SELF_ID)), folds.insert_attestations(batch.attestations), "msg_id"
        ),
        "blocks": (folds.insert_blocks(jobs.gossip_stream(stream, "block", bridge.SELF_ID)), folds.insert_blocks(batch.blocks), "msg_id"),
    }
    for name, (streamed, wanted, key) in cases.items():
        got = jobs.fold_to_end(streamed, str(tmp_path / name), key)
        assert rows(got.select(wanted.columns)) == rows(wanted)
        assert len(list((tmp_path / name).glob("batch=*"))) == 4


def test_nodes_and_addresses(spark, batch, tmp_path):
    records = batch.raw_records
    for n in range(3):
        records.filter(F.floor(F.col("ord") % 300 / 100) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    table = jobs.fold_to_end(folds.node_rows(normalise.normalise_records(stream)), str(tmp_path / "n"), "node_id")
    wanted = folds.fold_eth_nodes(batch.records)
    assert rows(folds.nodes_by_pair(table).select(wanted.columns)) == rows(wanted)
    # A repeated batch replaces itself.
    before = rows(jobs.folded(spark, str(tmp_path / "n"), table.schema, "node_id"))
    last = spark.read.parquet(str(tmp_path / "n" / "batch=2"))
    copy = str(tmp_path / "copy")
    last.write.parquet(copy)
    spark.read.schema(last.schema).parquet(copy).write.mode("overwrite").parquet(str(tmp_path / "n" / "batch=2"))
    assert rows(jobs.folded(spark, str(tmp_path / "n"), table.schema, "node_id")) == before


def test_gossip_dedup_and_rows(spark, stream, batch, tmp_path):
    out = jobs.dedup_gossip(jobs.gossip_stream(stream, "attestation", bridge.SELF_ID))
    schema = out.schema
    jobs.run_to_end(out, str(tmp_path / "d"))
    got = spark.read.schema(schema).parquet(str(tmp_path / "d"))
    wanted = folds.insert_attestations(batch.attestations)
    assert rows(got.select("msg_id")) == rows(wanted.select("msg_id"))


def test_gossip_dedup_within_watermark(spark, stream, batch, tmp_path):
    out = jobs.dedup_gossip(jobs.gossip_stream(stream, "block", bridge.SELF_ID), within="1 hour").select("msg_id")
    jobs.run_to_end(out, str(tmp_path / "d"))
    got = spark.read.parquet(str(tmp_path / "d"))
    ids = folds.insert_blocks(batch.blocks).select("msg_id")
    assert rows(got.distinct()) == rows(ids) and got.count() >= ids.count()


def test_ids_once_for_ever_without_state(spark, tmp_path):
    """Copies weeks apart, in the same batch and in the same date are found, without any state."""
    begin = datetime(2024, 1, 1)
    log = []
    for n in range(6):
        day = begin + timedelta(days=7 * n)
        log += [(f"m{n}-{i}", "s", 5, day + timedelta(minutes=i), i + 100 * n, n) for i in range(40)]
        log += [(f"m{k}-{i}", "again", 5, day + timedelta(minutes=50, seconds=i), 50 + i + 100 * n, n) for k in range(n) for i in range(0, 40, 7)]
        log += [(f"m{n}-3", "again", 5, day + timedelta(minutes=59), 99 + 100 * n, n), (f"zero{n}", "s", 0, day, 98 + 100 * n, n)]
    frame = spark.createDataFrame(log, "msg_id string, sender string, slot long, arrival_time timestamp, seq long, file int")
    for n in range(6):
        frame.filter(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, table = jobs.dedup_table(stream, str(tmp_path / "out"))
    wanted = folds.first_by_message(frame.drop("file"))
    assert rows(table().select("msg_id", "sender")) == rows(wanted.select("msg_id", "sender")) and wanted.count() == 240
    assert all(not p["stateOperators"] for p in query.recentProgress)
    dates = spark.read.parquet(str(tmp_path / "out" / "bitmaps")).select("date").distinct().count()
    assert dates == 6


def test_message_rates_on_closed_windows(spark, stream, batch, tmp_path):
    out = jobs.message_rates(bridge.messages(stream), "15 seconds")
    jobs.run_to_end(out, str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    wanted = distributions.messages_per_topic(batch.messages)
    border = got.agg(F.max("window_start")).first()[0]
    assert rows(got) == rows(wanted.filter(F.col("window_start") <= border).select(got.columns))


def test_topic_senders_are_close(spark, stream, batch, tmp_path):
    """Hourly sketches of a stream, rolled up to days and to the whole, stay within 5 % (or one) of exact counts."""
    jobs.run_to_end(jobs.topic_senders(bridge.messages(stream)), str(tmp_path / "t"))
    sketches = spark.read.parquet(str(tmp_path / "t"))
    border = sketches.agg(F.max("window_start") + F.expr("INTERVAL 1 HOUR")).first()[0]
    seen = batch.messages.filter(F.col("arrival_time") < F.lit(border))
    for day, stamp in ((F.to_date("window_start"), F.to_date("arrival_time")), (F.lit(1), F.lit(1))):
        got = distributions.united_senders(sketches, day.alias("day"), "topic")
        exact = seen.groupBy(stamp.alias("day"), "topic").agg(F.count_distinct("sender").alias("n"))
        both = got.join(exact, ["day", "topic"], "full")
        assert both.count() == exact.count() > 60
        assert both.filter("peers IS NULL OR abs(peers - n) > greatest(1, 0.05 * n)").count() == 0


def test_published_events(spark, stream, batch, tmp_path):
    out = jobs.attestation_event_stream(jobs.gossip_stream(stream, "attestation", bridge.SELF_ID), batch.peers_listed)
    jobs.run_to_end(out, str(tmp_path / "p"))
    wanted = sinks.attestation_event_json(sinks.timed_attestations(batch.attestations, batch.peers_listed))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(wanted)


def test_published_batches_do_not_move_the_peer_table(spark, stream, batch, tmp_path):
    peers = tables.bucketed(batch.peers_listed, "peer_id")
    jobs.publish_timed(jobs.gossip_stream(stream, "attestation", bridge.SELF_ID), peers, str(tmp_path / "p"))
    wanted = sinks.attestation_event_json(sinks.timed_attestations(batch.attestations, batch.peers_listed))
    assert rows(spark.read.parquet(str(tmp_path / "p")).select(wanted.columns)) == rows(wanted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = peers.withColumnRenamed("peer_id", "sender")
        text = sinks.senders_found(batch.attestations, known)._jdf.queryExecution().executedPlan().toString()
        assert text.count("SortMergeJoin") == 1 and text.count("Exchange hashpartitioning") == 1  # of the senders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unknown_sender_is_published_empty(batch):
    nobody = batch.peers_listed.limit(0)
    timed = sinks.timed_attestations(batch.attestations, nobody)
    assert timed.count() == batch.attestations.count()
    info = timed.first().peer_info
    assert (info.ip, info.port, info.user_agent, info.latency, info.protocols) == ("", 0, "", 0, [])


def test_ticks(spark, stream, batch, tmp_path):
    jobs.metrics_tick(stream, str(tmp_path / "m"), lambda b: metrics_snapshot(Tables(peers=batch.peers), AS_OF))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.select("tick").distinct().count() == 4
    one = metrics_snapshot(Tables(peers=batch.peers), AS_OF)
    assert rows(got.filter("tick = 2").drop("tick")) == rows(one)
    jobs.snapshot_tick(stream, str(tmp_path / "n"), lambda: batch.peers, lambda n: f"2001-08-0{n + 2} 00:00:00")
    stamps = spark.read.parquet(str(tmp_path / "n")).select("timestamp").distinct().collect()
    assert sorted(r.timestamp.day for r in stamps) == [2, 3, 4, 5]
    assert jobs.live_trigger() == {"processingTime": "15 seconds"}


def test_identify_rows_on_stream(spark, stream, batch, tmp_path):
    hosts, _, status, _ = normalise.identify_events(bridge.raw_connections(stream))
    jobs.run_to_end(status, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(batch.identified()[2])
    assert hosts.isStreaming
