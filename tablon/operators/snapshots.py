"""What changed between consecutive full snapshots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablon.session import cut_lineage

ADDED, REMOVED, CHANGED = "alta", "baja", "cambio"
BYTES_PER_BUCKET = 64 << 20  # of the table's columns as they are stored
BROADCAST_KEYS = 1_000_000  # differing keys that are sent to all executors: about 100 MB
_PAIR = np.dtype([("hi", np.int64), ("lo", np.int64)])


def _hash(columns: list[Column], seed: int) -> Column:
    """64 bits of the values and of which of them are null (xxhash64 passes over nulls)."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(seed), *parts)


def _snapshot_order(rows: DataFrame, runs: DataFrame, scope: list[str]) -> DataFrame:
    """``run, sid, at, last``: the runs that have rows, numbered within their scope by time (then by run), with the
    scope's hash and whether the scope has none after it."""
    w = Window.partitionBy(*[F.col(c) for c in scope]).orderBy("fecha", "corrida_id")
    present = rows.select("corrida_id").distinct()
    return (
        runs.select("corrida_id", "fecha", *scope).where("corrida_id is not null and fecha is not null")
        .dropDuplicates(["corrida_id"])
        .join(present, "corrida_id", "left_semi")
        .select(
            F.col("corrida_id").alias("run"), _hash([F.col(c) for c in scope], 3).alias("sid"),
            F.row_number().over(w).alias("at"), F.lead("corrida_id").over(w).isNull().alias("last"),
        )
    )


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Differences of the keys of one partition, which holds all rows of each of its keys. Each snapshot's keys are a
    sorted array of 128-bit hashes, in which those of its neighbour are searched. ``at`` is the later snapshot's
    place in its scope, ``held`` that of the snapshot that has the key."""
    parts_read = [b for b in batches if len(b)]
    if not parts_read:
        return
    group = pd.concat(parts_read, ignore_index=True)
    sid, at, last = (group[c].to_numpy(t) for c, t in (("sid", np.int64), ("at", np.int32), ("last", bool)))
    keys = np.empty(len(group), _PAIR)
    keys["hi"], keys["lo"] = group["k1"].to_numpy(np.int64), group["k2"].to_numpy(np.int64)
    value, received = group["v"].to_numpy(np.int64), group["latest"].to_numpy(np.int64)
    del group, parts_read
    # Of a key's rows in one snapshot the one received last counts, of those at once the greatest.
    order = np.lexsort((value, received, keys["lo"], keys["hi"], at, sid))
    sid, at, last, keys, value = (x[order] for x in (sid, at, last, keys, value))
    kept = np.r_[(sid[1:] != sid[:-1]) | (at[1:] != at[:-1]) | (keys[1:] != keys[:-1]), True][: len(sid)]
    sid, at, last, keys, value = (x[kept] for x in (sid, at, last, keys, value))
    starts = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (at[1:] != at[:-1])][: len(sid)])
    parts = {(sid[a], at[a]): (a, b) for a, b in zip(starts, np.r_[starts[1:], len(sid)])}

    kinds = (ADDED, REMOVED, CHANGED)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(rows: np.ndarray, later: int, kind: str) -> None:
        out.append((rows, np.full(len(rows), later, np.int32), np.full(len(rows), kinds.index(kind), np.int8)))

    for (s, n), (a, b) in parts.items():
        rows = np.arange(a, b)
        c, d = parts.get((s, n + 1), (0, 0))
        if c == d:
            if not last[a]:
                found(rows, n + 1, REMOVED)
        else:
            place = np.minimum(np.searchsorted(keys[c:d], keys[a:b]), d - c - 1)
            same = keys[c:d][place] == keys[a:b]
            found(rows[~same], n + 1, REMOVED)
            found((c + place)[same & (value[c:d][place] != value[a:b])], n + 1, CHANGED)
        if n > 1:
            c, d = parts.get((s, n - 1), (0, 0))
            fresh = np.ones(b - a, bool)
            if c < d:
                place = np.minimum(np.searchsorted(keys[c:d], keys[a:b]), d - c - 1)
                fresh = keys[c:d][place] != keys[a:b]
            found(rows[fresh], n, ADDED)
    if out:
        rows, later, kind = (np.concatenate(x) for x in zip(*out))
        yield pd.DataFrame({"sid": sid[rows], "at": later, "held": at[rows], "k1": keys["hi"][rows], "k2": keys["lo"][rows], "cambio": np.array(kinds, object)[kind]})


def _bucket_count(rows: DataFrame) -> int:
    """Buckets for a table by the planner's estimate of its size, which comes from its files; as many as shuffles have where it
    has none (checkpointed rows)."""
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = math.ceil(size / BYTES_PER_BUCKET) if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, known, spark.sparkContext.defaultParallelism)


def snapshot_differences(
    rows: DataFrame, runs: DataFrame, key: Column, compared: list[str], name: str = "enlace",
    scope: tuple[str, ...] = ("portal", "tipo_operacion"), buckets: int | None = None, latest: str = "recibido_en", broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``corrida_id, <name>, cambio``: for every two consecutive snapshots of a scope, the keys
    added (``alta``), removed (``baja``) and changed (``cambio``: a column of ``compared`` differs,
    null equals null).

    Snapshots follow each other by ``runs.fecha``; a run without rows is none, and a scope's first
    yields no row. Hashes of keys (128 bits) and of the compared values (64 bits) are shuffled once, to
    buckets of keys, in which numpy sorts and searches them; the planner's estimate of the table's size gives their number,
    about BYTES_PER_BUCKET each of any scopes, so neither a scope nor a key's history makes a large task. The
    key's text is then read back: differing keys of under ``broadcast_keys`` rows, which are counted, are
    sent to where the texts are, so that no other text is moved; more of them meet the texts by a shuffle join. A key
    repeated within a snapshot counts once, with the row received
    last. Rows of null key or of a run that isn't in ``runs`` don't count; empty tables give no
    rows. Other columns, of whatever names, aren't read.
    """
    number = buckets or _bucket_count(rows)
    order = _snapshot_order(rows, runs, list(scope))
    keyed = rows.select(F.col("corrida_id").alias("run"), key.alias("__key"), F.unix_micros(F.col(latest).cast("timestamp")).alias("latest"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(compared)])
    slim = keyed.where("run is not null and __key is not null").join(order, "run")
    k1, k2 = _hash([F.col("__key")], 1), _hash([F.col("__key")], 2)
    hashed = slim.select(
        "sid", "at", "last", k1.alias("k1"), k2.alias("k2"), _hash([F.col(f"__v{i}") for i in range(len(compared))], 4).alias("v"), F.coalesce("latest", F.lit(-(1 << 63))).alias("latest")
    )
    found = hashed.repartition(number, "k1").mapInPandas(_differences, "sid long, at int, held int, k1 long, k2 long, cambio string")
    found = cut_lineage(found)
    texts = slim.select("sid", F.col("at").alias("held"), k1.alias("k1"), k2.alias("k2"), "__key")
    few = found.limit(broadcast_keys).count() < broadcast_keys
    # A key's text is the same wherever it stands, so its repeats are one.
    full = texts.join(F.broadcast(found) if few else found, ["sid", "held", "k1", "k2"]).select("sid", "at", F.col("__key").alias(name), "cambio").distinct()
    later = order.select("sid", "at", F.col("run").alias("corrida_id"))
    return full.join(later, ["sid", "at"]).select("corrida_id", name, "cambio")
