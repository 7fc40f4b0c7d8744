"""Backward as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablon.session import cut_lineage

ROWS_PER_GROUP = 500_000


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: dict[str, str],
    times: tuple[str, str],
    keep: dict[str, str],
    width_s: int = 30 * 86400,
    tie: str | None = None,
    rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """Left rows, each with the columns ``keep`` (right name -> new name) of the latest right
    row of the same entity whose time is at or before its own.

    ``by`` maps left key columns to right ones, ``times`` names both time columns. Time is
    cut into blocks of ``width_s`` seconds: rows are ordered within (entity, block) only,
    and what the blocks before leave over is carried between blocks, of which there are few.
    Right rows of one entity and instant are one before that. A block with more than ``rows_per_group``
    right rows is cut into finer ones, and the left rows of what then still is as large are dealt
    out to several groups, which all get the block's right rows. So no task sorts an entity's whole
    history, however many rows it has, nor all rows of a hot one's block.

    Null keys or times match nothing; such left rows stay, with nulls. Of right rows at one
    time the greatest ``tie`` (else the greatest kept values) wins. Left rows are never
    lost or repeated; either side may be empty. Kept columns get their new names; the
    caller chooses names that the left side lacks.
    """
    left_time, right_time = times
    keys = [f"__k{i}" for i in range(len(by))]
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    a = left.select(
        F.struct(*[left[c] for c in left.columns]).alias("__row"),
        *[left[c].alias(k) for c, k in zip(by, keys)],
        seconds(left[left_time]).alias("__t"),
    )
    payload = F.struct(
        seconds(right[right_time]).alias("at"),
        (right[tie] if tie else F.lit(0)).alias("tie"),
        *[right[c].alias(f"v{i}") for i, c in enumerate(keep)],
    )
    b = right.select(
        *[right[c].alias(k) for c, k in zip(by.values(), keys)],
        seconds(right[right_time]).alias("__t"),
        payload.alias("__p"),
    ).dropna(subset=[*keys, "__t"])
    b = b.groupBy(*keys, "__t").agg(F.max("__p").alias("__p"))
    width = width_s * 1_000_000
    cell = F.floor(F.col("__t") / F.lit(width)).alias("__b")
    a, b = a.select("*", cell), b.select("*", cell)

    # Only blocks that are too large for a group have a row here.
    counts = a.groupBy(*keys, "__b").agg(F.count("*").alias("__nl"), F.lit(0).cast("bigint").alias("__nr")).unionAll(
        b.groupBy(*keys, "__b").agg(F.lit(0).cast("bigint"), F.count("*"))
    )
    sizes = counts.groupBy(*keys, "__b").agg(F.sum("__nl").alias("__nl"), F.sum("__nr").alias("__nr")).where(F.greatest("__nl", "__nr") > rows_per_group)
    fine = F.ceil(F.col("__nr") / rows_per_group)
    hot = cut_lineage(sizes.select(*keys, "__b", F.greatest(fine, F.lit(1)).alias("__fine"), F.greatest(F.ceil(F.col("__nl") / (F.greatest(fine, F.lit(1)) * rows_per_group)), F.lit(1)).alias("__parts")))
    if hot.limit(1).isEmpty():
        a, b = (x.withColumns({"__s": F.lit(0), "__part": F.lit(0)}) for x in (a, b))
    else:
        inside = F.floor((F.col("__t") - F.col("__b") * width) / (F.lit(width) / F.coalesce("__fine", F.lit(1)))).cast("int")
        parts = F.coalesce("__parts", F.lit(1))
        a = a.join(hot, [*keys, "__b"], "left").withColumns({"__s": F.coalesce(inside, F.lit(0)), "__part": F.pmod(F.monotonically_increasing_id(), parts).cast("int")}).drop("__fine", "__parts")
        b = b.join(hot, [*keys, "__b"], "left").withColumns({"__s": inside, "__part": F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))}).drop("__fine", "__parts")

    group = [*keys, "__b", "__s"]
    per_block = b.where("__part = 0").groupBy(*group).agg(F.max("__p").alias("__last"))
    wanted = a.where(F.col("__t").isNotNull()).select(*group).distinct()
    grid = wanted.join(per_block, group, "full")
    before = Window.partitionBy(*keys).orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    carry = grid.select(*group, F.last("__last", True).over(before).alias("__carry"))

    row_type, p_type = a.schema["__row"].dataType, b.schema["__p"].dataType
    both = a.select(*group, "__part", "__t", F.lit(1).alias("__kind"), "__row", F.lit(None).cast(p_type).alias("__p")).unionAll(
        b.select(*group, "__part", "__t", F.lit(0).alias("__kind"), F.lit(None).cast(row_type).alias("__row"), "__p")
    )
    within = Window.partitionBy(*group, "__part").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select(*group, "__t", "__kind", "__row", F.max("__p").over(within).alias("__p")).where("__kind = 1")
    joined = seen.join(carry, group, "left")
    best = F.when(F.col("__t").isNotNull(), F.coalesce("__p", "__carry"))
    return joined.select(
        F.col("__row.*"), *[best.getField(f"v{i}").alias(new) for i, new in enumerate(keep.values())]
    )
