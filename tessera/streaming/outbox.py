"""Delivery with retries: an outbox as tables (STM-02, STM-03) and a sink for streams that survives replays.

``claim``, ``recover`` and ``settle`` say what a step of a lease-based outbox does
to its rows. On Spark the checkpoint of a stream takes the place of leases:
``deliver`` hands each micro-batch to a handler and keeps what failed for the next
one. All it writes lies in a partition of its step, so a batch that runs again
after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Retries of a row before it fails for good.
RETRIES = 3
EXPIRED = "processing lease expired"


def claim(outbox: DataFrame, worker: str, now: dt.datetime, lease: dt.timedelta, limit: int = 20) -> DataFrame:
    """STM-03. The outbox with its ``limit`` oldest pending rows (by created_at, id) in processing, leased to the worker.

    outbox: id, status, created_at, retry_count, lease_owner, lease_expires_at,
    error_message, and any other columns. Only ``limit`` ids are sent around.
    """
    taken = outbox.filter("status = 'pending'").select("id", "created_at").orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("_taken"))
    x = outbox.join(F.broadcast(taken), "id", "left")
    own = lambda value, c: F.when(F.col("_taken"), value).otherwise(F.col(c)).alias(c)
    new = {"status": F.lit("processing"), "lease_owner": F.lit(worker), "lease_expires_at": F.lit(now + lease)}
    return x.select(*(own(new[c], c) if c in new else F.col(f"`{c}`") for c in outbox.columns))


def recover(outbox: DataFrame, now: dt.datetime, retries: int = RETRIES) -> DataFrame:
    """STM-02. Rows whose lease has expired are pending again, or failed after ``retries`` retries; they count one more."""
    expired = F.coalesce((F.col("status") == "processing") & (F.col("lease_expires_at") < F.lit(now)), F.lit(False))
    new = {
        "status": F.when(F.col("retry_count") < retries, "pending").otherwise("failed"), "retry_count": F.col("retry_count") + 1,
        "lease_owner": F.lit(None), "lease_expires_at": F.lit(None), "error_message": F.lit(EXPIRED),
    }
    return outbox.select(*(F.when(expired, new[c]).otherwise(F.col(c)).cast(outbox.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in outbox.columns))


def settle(outbox: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``done`` (id, worker) are processed, if they are in processing and the worker still holds their lease."""
    by = done.groupBy("id").agg(F.collect_set("worker").alias("_w"))
    x = outbox.join(by, "id", "left")
    held = F.coalesce((F.col("status") == "processing") & F.array_contains("_w", F.col("lease_owner")), F.lit(False))
    return x.select(*(F.when(held, "processed").otherwise(F.col(c)).alias(c) if c == "status" else F.col(f"`{c}`") for c in outbox.columns))


#: handler(rows, step) -> rows with ok boolean and error string; it may have effects outside if they are keyed by step.
Handler = Callable[[DataFrame, str], DataFrame]


class Delivery:
    """Tables of a delivery below a shared folder: delivered, waiting and dead, each by step.

    A step is a batch id and a round. Step s works on the rows of its batch and
    on those that the last step before s left waiting.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, retries: int = RETRIES):
        self.spark, self.folder, self.retries = spark, folder.rstrip("/"), retries
        self.rows = T.StructType([*schema.fields, T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])
        self.stored = T.StructType([*self.rows.fields, T.StructField("step", T.StringType())])
        for t in ("delivered", "waiting", "dead"):
            spark.createDataFrame([], self.stored).write.mode("append").partitionBy("step").parquet(f"{self.folder}/{t}")

    def table(self, name: str) -> DataFrame:
        """delivered, waiting or dead; of waiting only the last step is open."""
        return self.spark.read.schema(self.stored).parquet(f"{self.folder}/{name}")

    def _steps(self) -> list[str]:
        """Steps that are complete: their marker is the last thing a step writes."""
        try:
            return sorted(r.step for r in self.spark.read.schema("step string").json(f"{self.folder}/steps").select("step").collect())
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def open_rows(self, before: str | None = None) -> DataFrame:
        """What the last complete step (before ``before``) left waiting."""
        steps = [s for s in self._steps() if before is None or s < before]
        return self.table("waiting").filter(F.col("step") == (steps[-1] if steps else "")).drop("step")

    def _write(self, rows: DataFrame, name: str, step: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/step={step}")

    def run(self, batch: DataFrame, handler: Handler, step: str) -> None:
        """One step; running it again replaces what it wrote."""
        fresh = batch.withColumns({"attempts": F.lit(0), "error": F.lit(None).cast("string")})
        todo = fresh.unionByName(self.open_rows(step))
        names = [f.name for f in self.rows.fields]
        tried = handler(todo, step)
        ok = F.coalesce(F.col("ok"), F.lit(False))
        # Written once, so a handler runs once a step and the three tables agree.
        out = tried.select(*(F.col(f"`{c}`") for c in names if c not in ("attempts", "error")), F.when(ok, F.col("attempts")).otherwise(F.col("attempts") + 1).alias("attempts"), F.when(~ok, F.coalesce(F.col("error"), F.lit("not ok"))).alias("error"), ok.alias("_ok"))
        self._write(out, "tried", step)
        out = self.spark.read.schema(T.StructType([*self.rows.fields, T.StructField("_ok", T.BooleanType())])).parquet(f"{self.folder}/tried/step={step}")
        spent = F.col("attempts") > self.retries
        for name, rows in (("delivered", out.filter("_ok")), ("waiting", out.filter(~F.col("_ok") & ~spent)), ("dead", out.filter(~F.col("_ok") & spent))):
            self._write(rows.drop("_ok"), name, step)
        self.spark.createDataFrame([(step,)], "step string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/steps/at={step}")

    def start(self, stream: DataFrame, handler: Handler, checkpoint: str, **trigger) -> StreamingQuery:
        """A query that delivers a stream; trigger as in ``DataStreamWriter.trigger``."""
        return stream.writeStream.foreachBatch(lambda df, i: self.run(df, handler, f"{i:012d}-000")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def finish(self, handler: Handler) -> int:
        """Rounds of retries after the last batch until nothing waits; their number. Not while a query runs."""
        rounds = 0
        nothing = self.spark.createDataFrame([], T.StructType(self.rows.fields[:-2]))
        while not self.open_rows().isEmpty():
            batch, last = self._steps()[-1].split("-")
            self.run(nothing, handler, f"{batch}-{int(last) + 1:03d}")
            rounds += 1
        return rounds
