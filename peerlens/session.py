"""Session defaults and the shared folder used to cut lineage."""

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="peerlens", master=None, **conf):
    """A session with the settings every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder every executor can reach: the one the cluster names in `spark.checkpoint.dir`.

    Only a local master, whose executors are this process, may go without and gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="peerlens-"))
        named = context.getCheckpointDir()
    return named


def run_dir(spark, name):
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"peerlens-{name}-{uuid.uuid4().hex}")


def cut(df, name="cut"):
    """Write `df` once as a table in the shared folder and continue from the copy.

    The copy has no lineage, is read column-wise and has known sizes, so later
    joins can choose a strategy by what was really written.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
