import glob
import json
import os

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.operators import audit, distributions, reports
from peerlens.plans import handlers
from peerlens.plans.queries import AS_OF, Inputs
from peerlens.plans.registry import MetricRegistry, Tables, default_registry
from peerlens.operators import normalise
from peerlens.schemas import TABLES
from peerlens.sources import bridge, geo, sinks, tables


def lines(path):
    out = []
    for part in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(part) as f:
            out += f.read().splitlines()
    return out


def test_tables_round_trip(spark, data, tmp_path):
    b = Inputs(spark, data)
    for name in TABLES:
        tables.save(b.table(name), str(tmp_path), name)
        back = tables.load(spark, str(tmp_path), name)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in TABLES[name]]
        assert back.count() == b.table(name).count() > 0
    # Stored peers: the network is a partition, the activity bound is pushed down.
    stored = tables.load(spark, str(tmp_path), "peer_info")
    active = distributions.client_distribution(stored, AS_OF, D.POLYGON)
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(network" in plan
    assert "GreaterThan(last_activity," in plan and "EqualTo(deprecated," in plan
    assert "ReadSchema: struct<client_name:string,deprecated:boolean,attempted:boolean,last_activity:bigint>" in plan
    expected = distributions.client_distribution(b.peers, AS_OF, D.POLYGON)
    assert sorted(active.collect()) == sorted(expected.collect())


def test_documents_are_json(spark, data, tmp_path):
    b = Inputs(spark, data)
    features = sinks.export_geojson(b.peers_listed, b.ips)
    path = sinks.write_lines(sinks.geojson_document(features), str(tmp_path / "geo"))
    document = json.loads("\n".join(lines(path)))
    assert document["type"] == "FeatureCollection" and len(document["features"]) == features.count()
    first = document["features"][0]
    assert first["geometry"]["type"] == "Point" and len(first["geometry"]["coordinates"]) == 2
    assert set(first["properties"]) == {"peer_id", "ip", "country", "city", "isp", "hosting"}
    rows = reports.peer_locations_small(b.peers_listed, b.ips, columns=10)
    path = sinks.write_lines(sinks.json_array_document(rows, "peer_id"), str(tmp_path / "array"))
    array = json.loads("\n".join(lines(path)))
    assert len(array) == rows.count() and list(array[0]) == rows.columns
    assert json.loads(sinks.export_json(rows).first().value)["peer_id"]


def test_exports_have_file_names(spark, data, tmp_path):
    b = Inputs(spark, data)
    paths = sinks.export_all(b.peers_listed, b.ips, str(tmp_path), networks=[D.ETHEREUM], exports="country", single_file=True)
    assert os.path.basename(paths[D.ETHEREUM, "country"]) == "ethereum_cl_peer_count_by_country.csv"
    text = lines(paths[D.ETHEREUM, "country"])
    assert text[0] == "country,country_code,peer_count,unique_asns,hosted_nodes,avg_lat,avg_lon"
    counts = [int(t.split(",")[2]) for t in text[1:]]
    assert counts == sorted(counts, reverse=True)
    combined = sinks.export_all(b.peers_listed, b.ips, str(tmp_path), exports="clients")
    assert os.path.basename(combined[None, "clients"]) == "all_networks_client_distribution.csv"
    # The run over all networks at once writes the same files.
    at_once = sinks.export_networks(b.peers_listed, b.ips, str(tmp_path / "all"))
    folder = os.path.join(at_once["country"], "file=ethereum_cl_peer_count_by_country.csv")
    assert lines(folder) == text or sorted(lines(folder)) == sorted(text)


def test_failed_geolocation_answers_are_dropped(spark):
    raw = spark.createDataFrame(
        [('{"query":"1.1.1.1","status":"success","country":"X","lat":1.5,"hosting":true}',),
         ('{"query":"2.2.2.2","status":"fail"}',), ("not json",)], "value string")
    (row,) = geo.ingest_ip_api(raw, "2024-01-01 00:00:00").collect()
    assert (row.ip, row.country, row.city, row.lat, row.lon, row.hosting, row.mobile) == ("1.1.1.1", "X", "", 1.5, 0.0, True, False)
    assert row.expiration_time.isoformat() == "2024-01-31T00:00:00"


def test_custom_metric_and_handler(spark, data):
    b = Inputs(spark, data)
    registry = MetricRegistry()
    registry.count("mine", "quic", lambda _: F.col("port") == 9001, F.col("network"))
    registry.count("mine", "nobody", lambda _: F.col("port") == 1)
    registry.query("mine", "rows", lambda t, at, n: t.peers.agg(F.count("*").alias("c")), "c")
    got = {(r.metric, r.label): r.value for r in registry.snapshot(Tables(peers=b.peers_listed), AS_OF).collect()}
    assert got["nobody", ""] == 0.0 and got["rows", ""] == 150.0
    assert sum(v for (m, _), v in got.items() if m == "quic") == b.peers_listed.filter("port = 9001").count()
    assert len(default_registry().metrics) == 24
    exits = handlers.Handler(
        matches=lambda pretty: pretty == "voluntary_exit", problem=lambda: F.lit(None).cast("string"),
        columns=lambda: [F.col("proposer").alias("validator")])
    more = handlers.with_handler("exit", exits)
    rows = normalise.gossip_to_rows(b.messages, "exit", bridge.SELF_ID, handlers=more)
    assert rows.count() > 0 and "validator" in rows.columns
    rejected = {r.reason for r in normalise.rejected_gossip(b.messages, bridge.SELF_ID, more).collect()}
    assert rejected == {"own message", "no subnet in topic"}


def test_published_coverage_figures(spark):
    """17,356 of 24,291 addresses located are 71 %; 3,744 shared are 30 % and 15 %."""
    n = spark.range(24291).select(F.lit("E").alias("network"), F.col("id").cast("string").alias("ip"))
    p = spark.range(24291 - 3744, 24291 - 3744 + 12470).select(F.lit("P").alias("network"), F.col("id").cast("string").alias("ip"))
    peers = n.unionByName(p).withColumn("deprecated", F.lit(False))
    ips = spark.range(17356).select(F.col("id").cast("string").alias("ip"))
    coverage = {r.network: r.coverage for r in audit.geo_coverage(peers, ips).collect()}
    assert coverage["E"] == 71.4 or coverage["E"] == 71.5
    share = audit.ip_overlap_share(peers).first()
    assert (share.shared_ips, round(share.pct_a), round(share.pct_b)) == (3744, 15, 30)
    total = audit.peers_by_network(peers).filter("network IS NULL").first()
    assert (total.peers, total.unique_ips) == (24291 + 12470, 24291 + 12470 - 3744)
