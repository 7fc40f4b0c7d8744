"""Tables that are replaced as a whole: numbered versions and a pointer to the current one."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablon.functions.identity import canonical_link, record_key
from tablon.operators.accumulate import keep_last


class VersionedTable:
    """Parquet folders ``v=N`` under ``path``, and ``_CURRENT``, which names the one that holds. A version
    is written whole before the pointer is replaced by a rename, so readers see one or the
    other; a run that dies leaves the old one. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        jvm, fs = self._fs()
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_CURRENT")
        if not fs.exists(pointer):
            return None
        stream = fs.open(pointer)
        try:
            return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The current rows, or those of a version; none yet gives an empty frame of the schema."""
        v = self.version() if version is None else version
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/v={v}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        v = (self.version() or 0) + 1
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{self.path}/v={v}")
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        draft = path(f"{self.path}/_NEXT")
        out = fs.create(draft, True)
        out.write(bytearray(str(v), "utf-8"))
        out.close()
        pointer = path(f"{self.path}/_CURRENT")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(draft), fs.makeQualified(pointer), options)
        return v


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only log."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The log, latest run first; empty if there is none. One that is there but can't be read is an error: were it
    taken for empty, runs would be applied twice. ``listado_completo`` that isn't stated is true."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(path)
    if "listado_completo" in log.columns:
        log = log.withColumn("listado_completo", F.coalesce("listado_completo", F.lit(True)))
    return log.orderBy("corrida_id", ascending=False)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class ScopedTable:
    """A state that is kept by scope: a ``VersionedTable`` for each, in a folder named by a hash of the scope's
    values. A run reads, joins and rewrites its own scope only, whatever the others hold."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, scope: list[str]):
        self.spark, self.path, self.schema, self.scope = spark, path.rstrip("/"), schema, scope

    def part(self, values: dict[str, str | None]) -> VersionedTable:
        """The table of one scope; nulls are values as others."""
        name = hashlib.sha1(json.dumps([values.get(k) for k in self.scope]).encode()).hexdigest()
        return VersionedTable(self.spark, f"{self.path}/alcance={name}", self.schema)

    def read(self) -> DataFrame:
        """The current rows of all scopes."""
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folders = [str(f.getPath()) for f in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory()]
        tables = [VersionedTable(self.spark, f, self.schema) for f in sorted(folders)]
        current = [f"{t.path}/v={v}" for t in tables if (v := t.version()) is not None]
        return self.spark.read.schema(self.schema).parquet(*current) if current else self.spark.createDataFrame([], self.schema)


def with_schema(df: DataFrame, required: StructType) -> DataFrame:
    """``df`` with the columns that it lacks of ``required``, as nulls of their type, behind its own."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in required.fields if f.name not in df.columns})


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with ``veces``; null keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("veces")).where("veces > 1")


def migrated_state(old: DataFrame, sector: str, scope_field: str, required: StructType) -> DataFrame:
    """Rows of an older state in the present form: canonical ``enlace``, ``clave_registro`` from it, missing columns as
    nulls, counters that aren't stated at their first values (no absences, active). Of rows that get one key
    the one seen last stays, so keys are unique."""
    has = lambda c: F.col(c) if c in old.columns else F.lit(None).cast("string")
    rows = old.withColumn("enlace", canonical_link(has("enlace")))
    rows = rows.withColumn("clave_registro", record_key(F.coalesce(has("sector"), F.lit(sector)), has("portal"), F.lit(scope_field), has(scope_field), F.col("enlace")))
    full = with_schema(rows, required).fillna({c: v for c, v in (("ausencias_consecutivas", 0), ("activo", True)) if c in {f.name for f in required.fields}})
    last = [F.col("ultima_vez_visto")] if "ultima_vez_visto" in full.columns else []
    return keep_last(full, ["clave_registro"], last)


def read_listings(
    state: DataFrame, sector: str, portal: str | None = None, operation: tuple[str, str] | None = None, only_active: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """Rows of the state of a sector, and of a portal, an operation (column, value) or the active ones if asked; ``columns`` in
    their order, those there are. All conditions reach the scan."""
    rows = state.where(F.col("sector") == sector)
    if portal:
        rows = rows.where(F.col("portal") == portal)
    if operation:
        rows = rows.where(F.col(operation[0]) == operation[1])
    if only_active:
        rows = rows.where("activo")
    return rows if columns is None else rows.select(*[c for c in columns if c in rows.columns])


def regenerate_view(rows: DataFrame, path: str) -> str | None:
    """Writes ``rows`` (``read_listings``) anew, without what was there; None, and nothing written, if there are none."""
    if rows.limit(1).isEmpty():
        return None
    rows.write.mode("overwrite").parquet(path)
    return path
