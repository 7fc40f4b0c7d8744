"""Runs as micro-batches: every batch changes the versioned state once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablon.operators.lifecycle import Policy, fold_runs
from tablon.session import cut_lineage
from tablon.sources.state import VersionedTable


def stream_runs(
    source: DataFrame, table: VersionedTable, checkpoint: str, scope: list[str], run_column: str, at_column: str,
    policy: Policy, columns: list[str], order: str | None = None, facts: DataFrame | None = None,
) -> StreamingQuery:
    """Applies every run of a stream of snapshot rows to the state, each scope's oldest first.

    A batch's runs are folded (``lifecycle.fold_runs``): the first ones of all scopes at once, then the
    second ones. A run needs all of its rows (the guard compares whole scopes), so it comes in one batch.
    ``facts`` (run, scope, at, complete, quality) tells what runs are like that have come, also those without rows
    that are older than the batch's last; unstated, they are complete and sound. The state holds the last
    run applied (``ultima_corrida``): a batch that is repeated after a failure changes nothing, whatever was
    written before.
    """

    def batch(df: DataFrame, _: int) -> None:
        rows = cut_lineage(df)
        last = rows.agg(F.max(run_column)).first()[0]
        if last is None:
            return
        state = table.read()
        done = state.agg(F.max("ultima_corrida")).first()[0] if "ultima_corrida" in state.columns else None
        if facts is not None:
            runs = facts.where(F.col(run_column) <= last)
        else:
            found = rows.groupBy(run_column, *scope).agg(F.max(at_column).alias("at"))
            runs = found.select(run_column, *scope, "at", F.lit(True).alias("complete"), F.lit("ok").alias("quality"))
        runs = runs.where(F.col(run_column) > (done if done is not None else -(1 << 63))).withColumn("rerun", F.lit(False))
        if runs.limit(1).isEmpty():
            return
        named = rows.select(F.col(run_column).alias("corrida_id"), *[c for c in columns if c != "corrida_id"])
        after = fold_runs(named, runs.withColumnRenamed(run_column, "corrida_id"), state.drop("ultima_corrida", "estado_anuncio"), policy, scope, order)
        table.write(after.withColumn("ultima_corrida", F.lit(last).cast("bigint")))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows for each window of event time and keys; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def written_counts(counts: DataFrame, folder: str) -> StreamingQuery:
    """Writes the current counts of a stream to ``folder``/conteos, replaced by every batch; what it needs to go on is in
    ``folder`` too, so that it should be shared."""

    def batch(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/conteos")

    return counts.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{folder}/avance").trigger(availableNow=True).start()
