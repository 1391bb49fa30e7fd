"""Run states, task supervision, audit streams and staged publication."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The transitions of runs.
ANALYSIS_RUN = {"PLANNED": ("RUNNING", "FAILED", "ROLLED_BACK"), "RUNNING": ("STAGED", "FAILED", "ROLLED_BACK"), "STAGED": ("COMMITTED", "FAILED", "ROLLED_BACK"), "COMMITTED": (), "FAILED": (), "ROLLED_BACK": ()}
SCOPE_RUN = {"PLANNED": ("RUNNING", "FAILED", "SKIPPED"), "RUNNING": ("STAGED", "FAILED", "SKIPPED"), "STAGED": ("COMMITTED", "FAILED", "SKIPPED"), "COMMITTED": (), "FAILED": (), "SKIPPED": ()}
RETRIES, BASE_MS, CAP_MS = 3, 100, 5000


def may_follow(old: Column, new: Column, table: dict) -> Column:
    out = F.lit(False)
    for a, bs in table.items():
        if bs:
            out = out | ((old == a) & new.isin(*bs))
    return out


def transitions(events: DataFrame, table: dict = ANALYSIS_RUN) -> DataFrame:
    """events (run_id, ord, status) with `legal`: a run starts as PLANNED, and each status may follow the one before."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("ord"))
    e = events.withColumn("before", before)
    return e.withColumn("legal", F.when(F.col("before").isNull(), F.col("status") == "PLANNED").otherwise(may_follow(F.col("before"), F.col("status"), table))).drop("before")


def run_states(events: DataFrame, table: dict = ANALYSIS_RUN) -> DataFrame:
    """run_id, status (the last), legal (all of it)."""
    return transitions(events, table).groupBy("run_id").agg(F.max_by("status", "ord").alias("status"), F.bool_and("legal").alias("legal"))


def default_identity(family: Column, declared: Column) -> Column:
    """A scope run's identity type: the declared one, else FLOW_ID for flows and SYMBOL_ID for others."""
    return F.coalesce(declared, F.when(family == "FLOW", "FLOW_ID").otherwise("SYMBOL_ID"))


def batch_errors(runs: DataFrame, scope_runs: DataFrame, status: str) -> DataFrame:
    """run_id, error of batches whose run or scope runs aren't in `status`."""
    own = runs.where(F.col("status") != status).select("run_id", F.concat(F.lit("run is "), F.col("status")).alias("error"))
    scope = scope_runs.where(F.col("status") != status).select("run_id", F.concat(F.lit("scope run "), F.col("scope_run_id"), F.lit(" is "), F.col("status")).alias("error"))
    return own.unionByName(scope)


def supervised(tasks: DataFrame, max_retries: int = RETRIES) -> DataFrame:
    """tasks (task_id, status, attempts, outcome) with `next`: what a running task becomes by its outcome."""
    bad = F.when(F.col("attempts") < max_retries, "RETRY_WAITING").otherwise(F.when(F.col("outcome") == "timeout", "TIMED_OUT").otherwise("FAILED"))
    state = F.when(F.col("outcome") == "cancel", F.when(F.col("status").isin("SUCCEEDED", "FAILED", "TIMED_OUT"), F.col("status")).otherwise("CANCELLED"))
    state = state.when(F.col("status") != "RUNNING", F.col("status")).when(F.col("outcome") == "success", "SUCCEEDED").when(F.col("outcome").isin("failure", "timeout"), bad).otherwise(F.col("status"))
    return tasks.withColumn("next", state)


def retry_delay_ms(attempt: int) -> int:
    return min(CAP_MS, BASE_MS * 2**attempt)


def is_transient(error: Exception) -> bool:
    return any(x in str(error).lower() for x in ("timeout", "temporar", "deadlock", "unavailable", "connection"))


def with_retry(commit: Callable[[], None], sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a commit; transient errors are retried. Returns the number of retries."""
    for attempt in range(RETRIES + 1):
        try:
            commit()
            return attempt
        except Exception as e:
            if attempt == RETRIES or not is_transient(e):
                raise
            sleep(retry_delay_ms(attempt) / 1000)
    raise AssertionError


class Published:
    """A table that is staged under a folder of its own and published by writing a pointer to it, last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stage(self, df: DataFrame) -> str:
        name = f"staged-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, name: str) -> None:
        made = self.spark.createDataFrame([(json.dumps({"table": name}), time.time_ns())], "pointer string, at bigint")
        made.coalesce(1).write.mode("append").json(f"{self.path}/pointers")

    def read(self) -> DataFrame:
        last = self.spark.read.schema("pointer string, at bigint").json(f"{self.path}/pointers").orderBy(F.desc("at")).first()
        return self.spark.read.parquet(f"{self.path}/{json.loads(last.pointer)['table']}")


def audit_stream(decided: DataFrame, path: str, checkpoint: str):
    """Appends a stream of audit rows to a table; each batch is a commit of its own."""
    return decided.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
