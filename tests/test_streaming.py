"""Streams against the batch operators, for any split into batches and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators.jobs import Limiter
from shelfscope.streaming.event_time import admitted_in_event_time
from shelfscope.streaming.upserts import compact, current, upsert_stream

SCHEMA = "k string, at timestamp, id long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def write(spark, folder, part, rows):
    spark.createDataFrame([(k, a, i) for k, a, i in rows], "k string, us long, id long").select("k", F.timestamp_micros("us").alias("at"), "id").coalesce(1).write.mode("append").parquet(f"{folder}/p={part}")


def run(spark, folder, sink, state, most):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    out = admitted_in_event_time(stream, key="k", at="at", order="id", most=most, within=60_000_000, delay="100 seconds")
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("most,pieces,stop", [(1, 2, 1), (3, 4, 2)])
def test_admission_in_event_time(rocks, tmp_path, most, pieces, stop):
    r = random.Random(most)
    events = sorted((r.choice("aab"), r.randrange(0, 90) * 5_000_000 + r.choice([0, 1, 999_999]), i) for i in range(160))
    events.sort(key=lambda e: e[1])
    parts = [events[len(events) * n // pieces : len(events) * (n + 1) // pieces] for n in range(pieces)]
    for p in parts:
        r.shuffle(p)
    folder, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n, p in enumerate(parts[:stop]):
        write(rocks, folder, n, [*p, ("none", None, 1000 + n)])
    run(rocks, folder, sink, state, most)
    for n, p in enumerate(parts[stop:], stop):  # the query goes on from its checkpoint
        write(rocks, folder, n, p)
    run(rocks, folder, sink, state, most)
    write(rocks, folder, "end", [("end", 10_000_000_000, 9999)])
    run(rocks, folder, sink, state, most)
    write(rocks, folder, "late", [("a", 5, 7777)])  # long after the watermark has passed
    run(rocks, folder, sink, state, most)
    got = {x.id: (x.k, x.us, x.admitted) for x in rocks.read.parquet(sink).select("k", F.unix_micros("at").alias("us"), "id", "admitted").collect()}
    limiters, want = {}, {1000 + n: ("none", None, False) for n in range(stop)}
    for k, at, i in sorted(events, key=lambda e: (e[1], e[2])):
        want[i] = k, at, limiters.setdefault(k, Limiter(most, 60_000_000)).admit(at)
    assert got == want and 0 < sum(v[2] for v in want.values()) < len(want)


def test_upserts_repeat_and_compact(spark, tmp_path):
    r, folder, log = random.Random(5), str(tmp_path / "in"), str(tmp_path / "log")
    rows, seen = [], {}

    def add(n):
        new = [(r.choice([1, 2, 3, 4, None]), len(rows) + i, f"v{len(rows) + i}") for i in range(20)]
        rows.extend(new)
        spark.createDataFrame(new, "k long, n long, v string").coalesce(1).write.mode("append").parquet(folder)
        seen.update({k: (n_, v) for k, n_, v in new if k is not None})

    def state():
        return {x.k: (x.n, x.v) for x in current(spark, log, key="k", order="n").collect()}

    def go(checkpoint):
        stream = spark.readStream.schema("k long, n long, v string").option("maxFilesPerTrigger", 1).parquet(folder)
        upsert_stream(stream, log, key="k", order="n", checkpoint=str(tmp_path / checkpoint)).awaitTermination()

    add(0), add(1)
    go("a")
    assert state() == seen
    go("again")  # all batches once more, by their numbers
    assert state() == seen
    add(2)
    go("a")
    assert state() == seen and spark.read.parquet(log).select("batch").distinct().count() == 3
    compact(spark, log, key="k", order="n")
    assert state() == seen and spark.read.parquet(log).select("batch").distinct().count() == 1
    add(3)
    go("a")
    assert state() == seen
