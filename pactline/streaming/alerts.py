"""Alert rules kept up to date as runs, check results and incidents are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactline import model
from pactline.plans import alerts
from pactline.sources.store import ControlStore

EVALUATION_INTERVAL = "30 seconds"
WATCHED = ("runs", "checks", "incidents")


def still_counting(live: DataFrame) -> DataFrame:
    """Contributions that rules can still look at: of each pipeline's latest run, and of runs with open incidents.

    Registration order only grows, so a run that is not the latest never is again; should
    more arrive of it, its whole contribution comes anew from the state.
    """
    newest = live.groupBy("pipeline").agg(F.max(F.struct("seq", "run_id")).alias("newest"))
    rows = live.alias("l").join(newest.alias("n"), "pipeline")
    return rows.where((F.col("open") > 0) | (F.struct("seq", "run_id") == F.col("newest"))).select("l.*")


def watch_alerts(store: ControlStore, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the state of every rule, under the batch number, after each arrival in a log it reads.

    No trigger looks at old events again. Spark's state has each run folded once, spread by
    run, and a trigger touches the runs that something arrived of. Their contributions
    are written as they leave the state, and replace the former ones in a small table, of one row per pipeline and run with open
    incidents, and the rules are sums over it. That table alternates between two folders
    beside the checkpoint, so a trigger that is repeated starts from what the one before
    left. Logs that are not there yet are made, so that their first rows are seen too.
    """

    def folder(epoch: int) -> str:
        return f"{checkpoint.rstrip('/')}/live/{epoch % 2}"

    def evaluate(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # The batch is looked at once only: it runs the stateful query, which has each run once.
        alerts.contributions(batch).write.mode("overwrite").parquet(folder(epoch))
        if epoch > 0:
            before, fresh = (spark.read.schema(alerts.LIVE).parquet(folder(e)) for e in (epoch - 1, epoch))
            b, f = still_counting(before).alias("b"), fresh.select(*model.RUN_KEY).alias("f")
            same = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in model.RUN_KEY]
            b.join(f, same, "left_anti").write.mode("append").parquet(folder(epoch))
        kept = spark.read.schema(alerts.LIVE).parquet(folder(epoch))
        alerts.rule_states(kept, store.pipelines()).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    def arrivals(table: str) -> DataFrame:
        store.make(table)
        return store.spark.readStream.schema(store.shape(table)).parquet(store.path(table))

    return (
        alerts.per_run(alerts.tagged(*map(arrivals, WATCHED)))
        .writeStream.outputMode("update")
        .foreachBatch(evaluate)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": EVALUATION_INTERVAL}))
        .start()
    )
