"""Commit churn over a stream, and tables that follow a stream of changed files."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.store import replace_repositories


def daily_churn(commits: DataFrame, watermark: str = "7 days") -> DataFrame:
    """(day, file, commits): a stream of (ts, file) counted by day; commits later than the watermark are left out."""
    counted = commits.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "file").agg(F.count("*").alias("commits"))
    return counted.select(F.to_date("window.start").alias("day"), "file", "commits")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, day, ts, commits): rows (file, day, ts) of a batch counted by file and day, with their latest time."""
    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by(["file", "day"]).aggregate([("ts", "max"), ("ts", "count")])
        yield from counted.rename_columns(["file", "day", "ts", "commits"]).to_batches()


EPOCH = date(1970, 1, 1)
DAY_MS = 86_400_000


class _DayBuckets(StatefulProcessor):
    """A file's commits by day (days since 1970) for as long as one counts, and a timer at the next day on which the sum can change."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "days array<int>, commits array<long>, done int, last int")

    def _load(self) -> tuple[dict[int, int], int, int]:
        if not self.held.exists():
            return {}, -(1 << 30), -(1 << 30)
        days, commits, done, last = self.held.get()
        return dict(zip(map(int, days), map(int, commits))), int(done), int(last)

    def _save(self, buckets: dict[int, int], done: int, last: int) -> None:
        self.held.update(([*buckets], [*buckets.values()], done, last))
        ahead = self._changes(buckets, done)
        if ahead:
            self.handle.registerTimer(min(ahead) * DAY_MS)

    def _changes(self, buckets: dict[int, int], done: int) -> set[int]:
        return {day + after for day in buckets for after in (1, self.days + 1) if day + after > done}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buckets, done, last = self._load()
        for frame in rows:
            for day, commits in zip(frame["day"], frame["commits"]):
                place = (day - EPOCH).days
                buckets[place] = buckets.get(place, 0) + int(commits)
        self._save(buckets, done, last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buckets, done, last = self._load()
        now = timerValues.getCurrentWatermarkInMs() // DAY_MS
        due = sorted(day for day in self._changes(buckets, done) if day <= now)
        if not due:  # an earlier timer has seen to it
            return
        known = sorted(buckets)
        sums = [0, *accumulate(buckets[day] for day in known)]
        found = []
        for as_of in due:
            end = bisect_left(known, as_of)
            last = max(last, known[end - 1]) if end else last
            found.append((as_of, sums[end] - sums[bisect_left(known, as_of - self.days)], last))
        self._save({day: n for day, n in buckets.items() if day + self.days + 1 > due[-1]}, due[-1], last)
        on = lambda place: EPOCH + timedelta(place)
        yield pd.DataFrame({"file": key[0], "as_of": [on(f[0]) for f in found], "churn": [f[1] for f in found], "last_commit": [on(f[2]) for f in found]})

    def close(self) -> None:
        pass


def rolling_churn(commits: DataFrame, days: int = 90, watermark: str = "7 days") -> DataFrame:
    """(file, as_of, churn, last_commit): a stream of commits (ts, files) as each file's commits of so many days before as_of.

    A row comes at each start of a day (UTC, as the session must be) on which a file's churn
    changes: after a day with commits, and when a day falls out, down to 0. Until the next
    row of the file it holds. Commits that are late by less than the watermark count on
    their own day, later ones may be left out. Commits without a time or files give nothing.
    State is a count a day and file, given up when it falls out; commits of a file and day
    are counted within each batch of rows before they are shuffled, so no file is hot.
    The session's spark.sql.streaming.stateStore.providerClass must be the RocksDB one.
    """
    touched = commits.where("ts is not null").select(F.explode("files").alias("file"), F.to_date("ts").alias("day"), "ts").where("file is not null")
    counted = touched.mapInArrow(_counted, "file string, day date, ts timestamp, commits long").withWatermark("ts", watermark)
    return counted.groupBy("file").transformWithStateInPandas(
        _DayBuckets(days), outputStructType="file string, as_of date, churn long, last_commit date", outputMode="Append", timeMode="EventTime"
    )


def keep_files_current(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of changed files (repo_id, path, content) over their repositories' partitions, batch by batch."""

    def replace(batch: DataFrame, _: int) -> None:
        replace_repositories(batch.dropDuplicates(["repo_id", "path"]), path)

    return changes.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
