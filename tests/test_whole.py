"""Queries that must read the whole of their tables."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from tidemark.registry.base import AS_OF


def test_changed_urls_of_all_sources(spark, sf_dir, tmp_path):
    for x in os.listdir(sf_dir):
        if x != "events.parquet":
            os.symlink(f"{sf_dir}/{x}", tmp_path / x)
    # source ids from 1 to 100
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.col("event_id") % 100).write.parquet(f"{tmp_path}/events.parquet")
    got = entry_mod.queries()["s27_changed_urls_all"](spark, str(tmp_path)).where(F.col("url").rlike("/sources/site(2[0-9]|[3-9][0-9]|100)$"))
    assert got.count() > 0


def test_time_ago_of_later_events(spark, sf_dir):
    later = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("ts") > F.lit(AS_OF).cast("timestamp_ntz")).select("event_id")
    got = entry_mod.queries()["h17_time_ago_all"](spark, sf_dir)
    rows = got.join(later, got["id"] == later["event_id"]).collect()
    assert rows and {r.en for r in rows} == {"just now"}
