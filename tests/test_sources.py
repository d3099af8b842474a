"""Readers, what reaches the scan, and the state of a stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import diagnostics, similarity
from shelfscope.sources import snapshots

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_only_what_a_query_needs_is_read(spark, tmp_path):
    t = snapshots.parquet_tables(spark, str(tmp_path))
    posts = spark.range(50).selectExpr("id AS ID", "'product' AS post_type", "'publish' AS post_status", "'t' AS post_title", "'x' AS post_content", "'s' AS post_name", "'d' AS post_date")
    posts.write.parquet(f"{tmp_path}/wp_posts.parquet")
    meta = spark.range(50).selectExpr("id AS post_id", "'_stock' AS meta_key", "'5' AS meta_value", "'unused' AS more")
    meta.write.parquet(f"{tmp_path}/wp_postmeta.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan_of(diagnostics.stock_settings(t))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<ID:bigint,post_type:string,post_status:string,post_title:string>" in text and "more" not in text
    assert "In(meta_key" in text and "EqualTo(post_status,publish)" in text
    assert diagnostics.stock_settings(t).where("stock_qty = '5'").count() == 50


def test_a_database_is_read_by_name(spark):
    with pytest.raises(Exception, match="(?i)driver|suitable"):
        snapshots.jdbc_tables(spark, "jdbc:none://store")("wp_posts").count()


def test_texts_of_a_snapshot_are_decoded(spark):
    rows = spark.createDataFrame([(1, "a &amp; b<\\/p> &eacute;", None)], "id int, name string, more string")
    assert [tuple(r) for r in snapshots.loaded(rows).collect()] == [(1, "a & b</p> é", None)]


def test_scores_by_features_equal_scores_by_pairs(spark):
    item = [("Soju Morango 360ml", "Lotte", "Morango", "360 ml", "789", "a1"), ("Caneca", None, None, None, None, None), ("Soju Uva", "Lotte", "Uva", "", "", "A1")]
    cand = [("Lotte soju morango 360 ml", ["Lotte"], "7-8-9", "zz"), ("Soju uva 0,36 l Lotte", None, None, "a1"), ("", [], "", "")]
    pairs = spark.createDataFrame([(*a, *b) for a in item for b in cand], "title string, brand string, variant string, net_content string, gtin string, sku string, c_name string, c_brands array<string>, c_gtin string, c_sku string")
    got = similarity.compare_listings(pairs)
    assert got.columns == [*pairs.columns, "score", "reasons"]
    found = {(r.title, r.c_name): r.score for r in got.collect()}
    assert found["Soju Morango 360ml", "Lotte soju morango 360 ml"] == 1.0 and found["Soju Uva", "Soju uva 0,36 l Lotte"] == 0.98 and found["Caneca", ""] == 0.0
    assert found["Soju Morango 360ml", "Soju uva 0,36 l Lotte"] == 0.7
    assert similarity.least_overlap(0.8) < 0.5 < similarity.least_overlap(0.8, variant=False, size=False)


def test_idle_keys_of_a_stream_are_given_up(spark, tmp_path):
    from shelfscope.streaming.admission import admitted_stream

    spark.createDataFrame([(1, 0), (1, 10), (1, 70), (2, 5), (2, None)], "k long, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at long").parquet(str(tmp_path / "in"))
    q = admitted_stream(stream, key="k", at="at", most=1, within=60, idle_seconds=3600).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    until = time.monotonic() + 90
    while spark.table("idle").count() < 5 and time.monotonic() < until:  # batches go on for the sake of timeouts
        time.sleep(1)
    q.stop()
    got = spark.table("idle").groupBy("k").agg(F.count_if("admitted").alias("n"), F.count("*").alias("all")).collect()
    assert sorted((r.k, r.n, r["all"]) for r in got) == [(1, 2, 3), (2, 1, 2)]
