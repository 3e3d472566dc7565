"""Keyed state for real-time issues: the last issues of each cell and day, and issues that are overdue.

Both keep what they need in Spark's state store, so a batch costs what it brings and not what is stored.
State is in RocksDB beside the checkpoint; a query that is started again goes on from there. Results are
stored in one folder a batch, which a batch that runs again replaces.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pluvia import schemas
from pluvia.config import Product
from pluvia.functions import dates, units
from pluvia.operators.consensus import KEYS
from pluvia.operators.daily import base_time
from pluvia.sources import writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Older issues of a cell and day that are kept behind the last ``n``, for those that turn out to have a
#: gap after they were counted.
SPARE = 12
ALARM = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("due", T.TimestampType()),
        T.StructField("arrived", T.TimestampType()),
    ]
)
_VOTE = T.StructType([f for f in schemas.CONSENSUS.fields if f.name != "product"])


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class LastIssues(StatefulProcessor):
    """The newest issues of a cell and day: time, millimetres so far, and whether a step is missing."""

    STATE = "issues array<bigint>, mm array<double>, gap array<boolean>"

    def __init__(self, product: Product, keep_ms: int | None):
        self.n, self.tol, self.ratio = product.last_n, product.tol, product.wet_ratio
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.keep_ms is None:
            self.newest = handle.getValueState("newest", self.STATE)
        else:
            self.newest = handle.getValueState("newest", self.STATE, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        if self.newest.exists():
            totals = {i: [mm, gap] for i, mm, gap in zip(*self.newest.get())}
        for batch in rows:
            for issue, mm in zip(batch["issue"].tolist(), batch["mm"].tolist()):
                total = totals.setdefault(issue, [0.0, False])
                if mm is None or mm != mm:
                    total[1] = True
                else:
                    total[0] += mm
        newest, known = {}, 0
        for issue in sorted(totals, reverse=True):  # gaps between the newest stay known as gaps
            known += not totals[issue][1]
            if known > self.n + SPARE:
                break
            newest[issue] = totals[issue]
        self.newest.update((
            list(newest), [float(t[0]) for t in newest.values()], [bool(t[1]) for t in newest.values()],
        ))
        last = np.array([t[0] for t in newest.values() if not t[1]][: self.n])
        wet = last > self.tol
        p, q = self.ratio
        enough = wet.any() and wet.sum() * q >= len(last) * p
        yield pd.DataFrame(
            {
                "cell_id": [key[0]], "valid_date": [key[1]],
                "mm": [float(last[wet].mean()) if enough else 0.0],
                "n_issues": [len(last)], "n_wet": [int(wet.sum())],
            }
        )

    def close(self) -> None:
        pass


def last_issues(
    steps: DataFrame, product: Product, keep: dt.timedelta | None = None
) -> DataFrame:
    """A stream of votes: a row for each cell and day that a batch touches, from its last issues.

    ``steps`` is a stream with the columns of ``daily_totals``. The votes are those of the batch
    operators, in any order of arrival and for issues in parts; a vote of no issues says that all that have
    come have a gap. An issue that turns out to have a gap after it was counted makes room for an
    older one, of which ``SPARE`` are kept. With ``keep`` the state of a cell and day goes when nothing
    has come for it for so long; what comes later starts anew.
    """
    valid = dates.valid_date(base_time(steps), F.col("step"), product.shift_hours)
    rows = steps.select(
        "cell_id", valid.alias("valid_date"),
        F.unix_micros(F.col("issue_ts").cast("timestamp")).alias("issue"),
        units.known(units.rate_to_mm(F.col("prate"))).alias("mm"),
    )
    processor = LastIssues(product, None if keep is None else int(keep.total_seconds() * 1000))
    votes = rows.groupBy("cell_id", "valid_date").transformWithStateInPandas(
        processor, _VOTE, "Update", "None" if keep is None else "ProcessingTime"
    )
    return votes.withColumn("product", F.lit(product.name)).select(*schemas.CONSENSUS.fieldNames())


def start(rows: DataFrame, path: str, checkpoint: str, mode: str, trigger: dict | None = None) -> StreamingQuery:
    """Stores what each batch gives below ``path``, in a folder named after the batch. A new checkpoint
    starts without state, so it needs a new ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.stage(batch.withColumn("batch", F.lit(batch_id)), path, "batch")

    with state_store(rows.sparkSession):
        return (
            rows.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def start_votes(
    steps: DataFrame, product: Product, path: str, checkpoint: str,
    keep: dt.timedelta | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Keeps the votes of a product up to date from keyed state; ``read_votes`` reads them.

    With ``keep`` the query needs a trigger that goes on: Spark runs batches for as long as state may
    expire, so one that works off what is there would never stop.
    """
    if keep is not None and "processingTime" not in (trigger or {}):
        raise ValueError("keep needs a trigger by processing time")
    return start(last_issues(steps, product, keep), path, checkpoint, "update", trigger)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """The newest vote of each cell and day."""
    stored = _stored(spark, path, schemas.CONSENSUS)
    newest = stored.groupBy(*KEYS).agg(F.max_by(F.struct("mm", "n_issues", "n_wet"), "batch").alias("v"))
    return newest.select(*KEYS, "v.*").filter("n_issues > 0")


class Overdue(StatefulProcessor):
    """Watches one issue: when it was due and when it first arrived, and what has been said about it."""

    STATE = "due bigint, arrived bigint, told boolean"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issue = handle.getValueState("issue", self.STATE)

    def _row(self, key, status: str, due: int, arrived: int | None) -> pd.DataFrame:
        times = [pd.to_datetime(pd.Series([t], dtype="Int64"), unit="us", utc=True) for t in (due, arrived)]
        return pd.DataFrame({"issue_id": [key[0]], "status": [status], "due": times[0], "arrived": times[1]})

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, arrived, told = self.issue.get() if self.issue.exists() else (None, None, False)
        for batch in rows:
            for a, b in zip(batch["due"].tolist(), batch["arrived"].tolist()):
                due = due if a is None or a != a else int(a) if due is None else min(due, int(a))
                arrived = arrived if b is None or b != b else int(b) if arrived is None else min(arrived, int(b))
        if due is not None and arrived is not None and arrived > due and not told:
            told = True
            yield self._row(key, "late", due, arrived)
        self.issue.update((due, arrived, told))
        if arrived is None:
            self._timer(due // 1000 + 1)  # after the due time itself
        else:
            self._timer(max(due or 0, arrived) // 1000 + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, arrived, _ = self.issue.get()
        if arrived is None and expiredTimerInfo.getExpiryTimeInMs() <= due // 1000 + 1:
            self.handle.registerTimer(due // 1000 + self.keep_ms)
            yield self._row(key, "missing", due, None)
        else:
            self.issue.clear()

    def close(self) -> None:
        pass


def overdue(
    expected: DataFrame, arrivals: DataFrame, latency: dt.timedelta,
    delay: str = "0 seconds", keep: dt.timedelta = dt.timedelta(days=30),
) -> DataFrame:
    """A stream of alarms (``issue_id, status, due, arrived``) about issues that do not come in time.

    ``expected`` is a stream of issues (``issue_id, issue_ts``), due ``latency`` after their time;
    ``arrivals`` one of what comes (``issue_id, arrived``: a zoned timestamp), any number of rows an
    issue. An issue is ``missing`` when the arrivals' watermark (``delay`` behind the newest arrival) has
    passed its due time and nothing of it has come; it is ``late``, once, when its first row came after
    that time, whether it was reported missing or not. Repeated rows of either stream change nothing.
    Arrivals that are older than the watermark are not seen. An issue's state goes ``keep`` after it is
    settled.
    """
    due = (F.col("issue_ts") + F.expr(f"INTERVAL {int(latency.total_seconds())} SECONDS")).cast("timestamp")
    nothing = F.lit(None).cast("bigint")
    # The arrivals alone are the clock: a planned issue has no event time, so it neither moves the
    # watermark nor falls behind it.
    planned = expected.select(
        "issue_id", F.lit(None).cast("timestamp").alias("at"), F.unix_micros(due).alias("due"),
        nothing.alias("arrived"),
    )
    came = arrivals.select(
        "issue_id", F.col("arrived").alias("at"), nothing.alias("due"),
        F.unix_micros("arrived").alias("arrived"),
    )
    rows = planned.unionByName(came).withWatermark("at", delay)
    return rows.groupBy("issue_id").transformWithStateInPandas(
        Overdue(int(keep.total_seconds() * 1000)), ALARM, "Append", "EventTime"
    )


def start_alarms(
    expected: DataFrame, arrivals: DataFrame, latency: dt.timedelta, path: str, checkpoint: str,
    delay: str = "0 seconds", keep: dt.timedelta = dt.timedelta(days=30), trigger: dict | None = None,
) -> StreamingQuery:
    """Stores the alarms as they are raised; ``read_alarms`` reads them."""
    return start(overdue(expected, arrivals, latency, delay, keep), path, checkpoint, "append", trigger)


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    """One row an issue that was reported: ``late`` if it came after all, else ``missing``."""
    stored = _stored(spark, path, ALARM)
    last = F.min_by(F.struct("status", "due", "arrived"), "status").alias("a")  # late comes first
    return stored.groupBy("issue_id").agg(last).select("issue_id", "a.*")
