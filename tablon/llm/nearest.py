"""Nearest record in time of the same entity, by x-fast tries of timestamp prefixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablon.session import cut_lineage

ROWS_PER_GROUP = 200_000
BLOCK_BITS = 6


class XFastTrie:
    """Predecessor and successor among sorted distinct integers below ``2 ** bits``.

    Level k is a hash table of the values' upper k bits; each prefix holds the range of its
    values. A query finds its longest prefix in the trie by binary search over the levels, so
    with one probe for each of log2(bits) steps, and there takes its neighbours. Queries are
    answered together, one probe of all at a time.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.values, self.bits = values, bits
        self.levels: list[tuple[pd.Index, np.ndarray, np.ndarray]] = []
        for k in range(bits + 1):
            prefix = values >> (bits - k)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(values) else np.array([], int)
            last = np.r_[first[1:], len(values)] - 1 if len(values) else first
            self.levels.append((pd.Index(prefix[first]), first, last))

    def neighbours(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the greatest value <= and the least value >= each query; -1 for none."""
        n = len(queries)
        if not len(self.values):
            return np.full(n, -1), np.full(n, -1)
        low, high = np.zeros(n, np.int64), np.full(n, self.bits, np.int64)  # the root holds every query
        node = np.zeros(n, np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            for k in np.unique(middle[open_]):
                rows = np.flatnonzero(open_ & (middle == k))
                place = self.levels[k][0].get_indexer(queries[rows] >> (self.bits - k))
                hit = place >= 0
                low[rows[hit]], node[rows[hit]] = k, place[hit]
                high[rows[~hit]] = k - 1
        before, after = np.full(n, -1), np.full(n, -1)
        for k in np.unique(low):
            rows = np.flatnonzero(low == k)
            _, first, last = self.levels[k]
            a, b = first[node[rows]], last[node[rows]]
            if k == self.bits:
                before[rows] = after[rows] = a
                continue
            # Below the longest shared prefix all values lie on one side of the query.
            larger = (queries[rows] >> (self.bits - k - 1)) & 1 == 0
            after[rows] = np.where(larger, a, b + 1)
            before[rows] = np.where(larger, a - 1, b)
        after[after >= len(self.values)] = -1
        return before, after


def nearest_in_time(
    left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], tolerance_s: int,
    rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """``left_id, right_id``: each left row with the right row of its entity that is nearest in time,
    before or after, if at most ``tolerance_s`` seconds away (inclusive).

    Columns are (id, entity, microseconds). Time is cut into blocks of 2 ** BLOCK_BITS tolerances or
    more. A block's right rows, and those within the tolerance of its borders, are the only ones
    that can match, and form one trie for each (entity, block). Blocks with many left rows are split
    among as many groups as hold ``rows_per_group`` each, and only their right rows are
    repeated; so an entity with a third of all rows is many tasks. Of two right rows equally
    near the earlier, of those at one time the least id wins. Null ids, entities and times
    match nothing; a left id repeated with one time comes out once for each row.
    """
    tolerance = int(tolerance_s * 1_000_000)
    bits = max(1, tolerance.bit_length()) + BLOCK_BITS
    a = left.select(*[F.col(c).alias(n) for c, n in zip(left_cols, ("id", "entity", "us"))]).dropna()
    b = right.select(*[F.col(c).alias(n) for c, n in zip(right_cols, ("id", "entity", "us"))]).dropna()
    a = cut_lineage(a.withColumn("block", F.shiftright("us", bits)))  # counted first, then matched
    b = b.groupBy("entity", "us").agg(F.min("id").alias("id"))
    b = b.withColumn("block", F.explode(F.array_distinct(F.array(*[F.shiftright(F.col("us") + i, bits) for i in (-tolerance, 0, tolerance)]))))
    sizes = a.groupBy("entity", "block").agg(F.ceil(F.count("*") / rows_per_group).cast("int").alias("parts"))
    split_b = b.join(sizes.toDF("entity", "block", "copies"), ["entity", "block"]).select(
        "entity", "block", "us", "id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part")
    )
    split_a = a.join(sizes, ["entity", "block"]).withColumn("part", F.pmod(F.xxhash64("id", "us"), F.col("parts")).cast("int"))

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="int64")})
        y = y.sort_values("us")
        base = (int(x["block"].iloc[0]) << bits) - tolerance
        values, queries = y["us"].to_numpy() - base, x["us"].to_numpy() - base
        before, after = XFastTrie(values, bits + 1).neighbours(queries)
        far = np.int64(1) << np.int64(62)
        gap_before = np.where(before >= 0, queries - values[before], far)
        gap_after = np.where(after >= 0, values[after] - queries, far)
        best, gap = np.where(gap_before <= gap_after, before, after), np.minimum(gap_before, gap_after)
        near = gap <= tolerance
        return pd.DataFrame({"left_id": x["id"].to_numpy()[near], "right_id": y["id"].to_numpy()[best[near]]})

    keys = ["entity", "block", "part"]
    return split_a.groupBy(keys).cogroup(split_b.groupBy(keys)).applyInPandas(match, "left_id long, right_id long")
