"""Control tables as append-only Parquet folders, and snapshots of what their logs add up to.

Nothing is updated in place. Registrations are first-writer-wins, runs and
incidents are event logs whose latest event counts; both are settled when the
tables are read; so are check results, one per check of a run, and notifications. A write
that was repeated does no harm.

Every append has a folder of its own below the hour it began in, so that writers never
share a folder. A snapshot holds the settled rows of all hours up to one, sorted and in
buckets by pipeline; readers take it and the events of younger hours. Hours are folded
only when nothing can arrive in them any more: a write that ends later than SLACK after
its hour is written again, to the current one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline import model
from pactline.plans import registry
from pactline.plans.runs import current_incidents, current_runs

# Tables cut into month folders, and the time the month comes from; check
# results carry none and get the start of their run handed in.
MONTH_SOURCE = {
    "runs": "started_at",
    "checks": None,
    "incidents": "first_observed_at",
    "notifications": "created_at",
}
#: Folders above the months: the hour of the write, and the write.
PLACE = "hour bigint, batch string"
#: How long after its hour a write may end, and, once more, how far clocks may be apart.
SLACK = timedelta(hours=1)
BUCKETS = 64

SNAPSHOTS = "upto bigint, buckets int, path string"


def hour_of(moment: datetime) -> int:
    return int(moment.astimezone(timezone.utc).strftime("%Y%m%d%H"))


def of_last_attempts(log: DataFrame) -> DataFrame:
    """Check results of each run's last attempt."""
    # Resumed runs are few: the files' statistics leave nothing else to read here.
    last = log.where("attempt > 1").groupBy(*model.RUN_KEY).agg(F.max("attempt").alias("last"))
    return log.join(last, model.RUN_KEY, "left").where("last IS NULL OR attempt = last").select(*log.columns)


def one_per_check(log: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One result for each check of a run, the smallest; more columns that follow from the run may be part of the key."""
    key = [*more, *model.RUN_KEY, "check_type"]
    rest = [c for c in log.columns if c not in key]
    # One sort by key, that looks at the texts of repeats only; a set of texts is built for every key.
    before = F.lag(F.lit(1)).over(W.partitionBy(*key).orderBy(*rest))
    return log.withColumn("before", before).where("before IS NULL").select(*key, *rest)


def settled_checks(log: DataFrame) -> DataFrame:
    """One result for each check of a run's last attempt, however often it was written."""
    return one_per_check(of_last_attempts(log))


#: Logs with snapshots, and how their rows are settled; settling again changes nothing.
SETTLED = {"runs": current_runs, "checks": one_per_check, "incidents": current_incidents}


class ControlStore:
    """Reads and appends the control tables below one folder."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark = spark
        self.root = root.rstrip("/")
        self.clock = clock

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame, time: date | None = None) -> None:
        """Add rows; ``time`` places rows that carry no time of their own."""
        names = [c.split()[0] for c in model.CONTROL_TABLES[table].split(", ")]
        if table == "checks" and "attempt" not in rows.columns:
            rows = rows.withColumn("attempt", F.lit(1))
        rows = rows.select(*names)
        if table in MONTH_SOURCE:
            source = MONTH_SOURCE[table]
            value = F.lit(time) if source is None else F.col(source)
            # Rebalancing gathers a month's rows into few files and splits a month
            # that is too large for one task.
            rows = rows.withColumn("month", F.trunc(value.cast("date"), "month")).hint("rebalance", "month")
        while True:
            began = self.clock()
            writer = rows.write.partitionBy("month") if table in MONTH_SOURCE else rows.write
            writer.parquet(f"{self.path(table)}/hour={hour_of(began)}/batch={uuid.uuid4().hex}")
            if hour_of(self.clock() - SLACK) <= hour_of(began):
                return

    def make(self, table: str) -> None:
        """Write an empty log where there is none; its folders tell Spark how the log is cut."""
        if self._read(model.CONTROL_TABLES[table], self.path(table)) is None:
            empty = self.spark.createDataFrame([], model.CONTROL_TABLES[table])
            empty.write.parquet(f"{self.path(table)}/hour=0/batch=none/month=1970-01-01")

    def _read(self, schema: str, path: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def shape(self, table: str) -> str:
        """Columns of a log's files and folders."""
        return ", ".join([model.CONTROL_TABLES[table], PLACE, *["month date"] * (table in MONTH_SOURCE)])

    def _placed(self, table: str) -> DataFrame:
        found = self._read(self.shape(table), self.path(table))
        return self.spark.createDataFrame([], self.shape(table)) if found is None else found

    def log(self, table: str, since: date | None = None) -> DataFrame:
        """Everything that was written, or only the month folders from a day on."""
        rows = self._placed(table)
        if since is not None:
            rows = rows.where(F.col("month") >= F.lit(since.replace(day=1)))
        return rows.drop("hour", "batch", "month")

    # -- snapshots ---------------------------------------------------------

    def _snapshot(self) -> tuple[int, int, str] | None:
        """(hour, buckets, path) of the newest complete snapshot."""
        known = self._read(SNAPSHOTS, self.path("snapshots"))
        newest = known and known.agg(F.max(F.struct("upto", "path", "buckets")).alias("top")).select("top.*").first()
        return (newest["upto"], newest["buckets"], newest["path"]) if newest and newest["path"] else None

    def _events(self, table: str, snapshot, pipeline: str | None = None) -> DataFrame:
        """Rows that settle to the table: the snapshot's, and the younger events."""
        rows = self._placed(table)
        if snapshot:
            upto, buckets, path = snapshot
            rows = rows.where(F.col("hour") > upto)
            folded = self._folded(table, path)
            if pipeline is not None:
                folded = folded.where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(pipeline)), F.lit(buckets)).cast("int"))
            rows = rows.drop("hour", "batch").unionByName(folded.drop("bucket"))
        else:
            rows = rows.drop("hour", "batch")
        return rows if pipeline is None else rows.where(F.col("pipeline") == pipeline)

    def _folded(self, table: str, path: str) -> DataFrame:
        return self.spark.read.schema(f"{model.CONTROL_TABLES[table]}, month date, bucket int").parquet(f"{path}/{table}")

    def fold(self, buckets: int = BUCKETS) -> int | None:
        """Write a snapshot of all closed hours; returns the last of them, None where none is new.

        Readers see it when its row is written, after everything else: a fold that dies
        before changes nothing. The logs stay.
        """
        before = self._snapshot()
        upto = hour_of(self.clock() - 2 * SLACK - timedelta(hours=1))
        if before and before[0] >= upto:
            return None
        path = f"{self.path('folded')}/upto={upto}-{uuid.uuid4().hex}"
        order = ["bucket", *model.RUN_KEY]
        for table, settle in SETTLED.items():
            closed = self._placed(table).where(F.col("hour") <= upto)
            closed = closed.where(F.col("hour") > before[0]) if before else closed
            closed = closed.drop("hour", "batch")
            if before:
                closed = closed.unionByName(self._folded(table, before[2]).drop("bucket"))
            closed = of_last_attempts(closed) if table == "checks" else closed
            closed = closed.withColumn("bucket", F.pmod(F.xxhash64("pipeline"), F.lit(buckets)).cast("int"))
            # A range may cut a bucket, so a pipeline that owns most runs is written by several tasks. It never
            # cuts a run, so rows are settled where they are written, without another shuffle.
            ranged = settle(closed.repartitionByRange(*order), ["bucket"]).sortWithinPartitions(*order)
            ranged.write.partitionBy("bucket").parquet(f"{path}/{table}")
        self._publish(upto, buckets, path)
        return upto

    def _publish(self, upto: int, buckets: int, path: str) -> None:
        row = self.spark.createDataFrame([(upto, buckets, path)], SNAPSHOTS)
        row.coalesce(1).write.parquet(f"{self.path('snapshots')}/batch={uuid.uuid4().hex}")

    # -- settled tables ----------------------------------------------------

    def pipelines(self) -> DataFrame:
        return registry.first_written(self.log("pipelines"), registry.PIPELINE_KEY)

    def datasets(self) -> DataFrame:
        return registry.first_written(self.log("datasets"), registry.DATASET_KEY)

    def contracts(self) -> DataFrame:
        return registry.first_written(self.log("contracts"), registry.CONTRACT_KEY)

    def runs(self, pipeline: str | None = None) -> DataFrame:
        return current_runs(self._events("runs", self._snapshot(), pipeline).drop("month"))

    def checks(self, since: date | None = None, pipeline: str | None = None) -> DataFrame:
        """One result for each check of a run, however often it was written."""
        rows = self._events("checks", self._snapshot(), pipeline)
        if since is not None:
            rows = rows.where(F.col("month") >= F.lit(since.replace(day=1)))
        return settled_checks(rows.drop("month")).drop("attempt")

    def incidents(self, pipeline: str | None = None) -> DataFrame:
        return current_incidents(self._events("incidents", self._snapshot(), pipeline).drop("month"))

    def notifications(self, since: date | None = None) -> DataFrame:
        return self.log("notifications", since).distinct()
