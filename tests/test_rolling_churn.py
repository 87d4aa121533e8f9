"""Ninety days of churn from a stream, against the commits of each day."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.resolve import commit_churn
from weftgraph.streaming.churn import rolling_churn

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "ts timestamp, files array<string>"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def test_each_day_equals_the_batch(rocks, tmp_path):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    commits = []
    for batch in range(4):
        base = start + timedelta(days=40 * batch)
        # Up to five days behind what the batches before have shown.
        rows = [(base + timedelta(hours=rng.randint(-5 * 24 if batch else 0, 20 * 24)), rng.sample(["a", "b", "c", "d"], rng.randint(1, 3))) for _ in range(30)]
        rows += [(base + timedelta(days=25), ["hot"])] * 5 + [(None, ["a"]), (base, None), (base, [])]
        if batch == 1:
            rows += [(start + timedelta(days=20, hours=1), ["late"])]  # the first batch ends at day 25
        commits += rows
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        _follow(rocks, inbox, out, str(tmp_path / "state"))
    rocks.createDataFrame([(start + timedelta(days=400), ["end"])], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    _follow(rocks, inbox, out, str(tmp_path / "state"))

    rows = sorted((r["file"], r["as_of"], r["churn"], r["last_commit"]) for r in rocks.read.parquet(out).collect())
    assert len({r[:2] for r in rows}) == len(rows)
    frame = rocks.createDataFrame(commits, SCHEMA).where("ts is not null").cache()
    for as_of in [date(2024, 1, 1) + timedelta(n) for n in (1, 9, 21, 26, 44, 61, 90, 111, 112, 140, 200, 240, 300)]:
        moment = F.lit(str(as_of)).cast("timestamp")
        want = {r["file"]: (r["churn"], r["last_commit"]) for r in commit_churn(frame.where(F.col("ts") < moment), moment).collect()}
        got = {}
        for file, day, churn, last in rows:
            if day <= as_of:
                got[file] = churn, last
        assert got == want, as_of
    assert any(r[0] == "late" for r in rows) and any(r[2] == 0 for r in rows)


def _follow(spark, inbox, out, state):
    stream = rolling_churn(spark.readStream.schema(SCHEMA).parquet(inbox))
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
