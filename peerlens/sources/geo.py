"""Geolocation answers."""

from pyspark.sql import functions as F

from peerlens import domains as D
from peerlens.schemas import GEO_ANSWER


def ingest_ip_api(raw, as_of, column="value"):
    """Answer documents (one JSON text per row) to `ips` rows.

    Keeps successful answers and stamps the expiry.  Missing text is ''.
    """
    a = F.from_json(F.col(column), GEO_ANSWER)
    answer = raw.select(a.alias("a")).filter(F.col("a.status") == "success")

    def text(name):
        return F.coalesce(F.col(f"a.{name}"), F.lit(""))

    def flag(name):
        return F.coalesce(F.col(f"a.{name}"), F.lit(False))

    return answer.select(
        F.col("a.query").alias("ip"),
        (F.lit(as_of).cast("timestamp") + F.expr(f"interval {D.IP_TTL_DAYS} days")).alias(
            "expiration_time"
        ),
        text("continent").alias("continent"),
        text("continentCode").alias("continent_code"),
        text("country").alias("country"),
        text("countryCode").alias("country_code"),
        text("region").alias("region"),
        text("regionName").alias("region_name"),
        text("city").alias("city"),
        text("zip").alias("zip"),
        F.coalesce(F.col("a.lat"), F.lit(0.0).cast("float")).alias("lat"),
        F.coalesce(F.col("a.lon"), F.lit(0.0).cast("float")).alias("lon"),
        text("isp").alias("isp"),
        text("org").alias("org"),
        text("as").alias("as_raw"),
        text("asname").alias("asname"),
        flag("mobile").alias("mobile"),
        flag("proxy").alias("proxy"),
        flag("hosting").alias("hosting"),
    )


def located_ips(ips):
    """Drop cache rows that carry neither country nor city."""
    return ips.filter(~((F.col("country") == "") & (F.col("city") == "")))
