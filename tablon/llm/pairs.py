"""Pairs of the members of groups, where the groups' pairs are what is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablon.session import cut_lineage

MEMBERS_PER_TASK = 2_000  # of a larger group, each task pairs this many members with all


def member_pairs(members: DataFrame, group: str, member: str, per_task: int = MEMBERS_PER_TASK) -> DataFrame:
    """``a, b`` (a < b): every two members of a group, from rows (``group, member``) without repeats.

    There are as many pairs as the result must have; a group with more than ``per_task`` members is dealt out: each
    part of it meets all members in a task of its own, so no task makes all pairs of a large group. Groups of
    one and null groups have none.
    """
    rows = cut_lineage(members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / per_task).cast("int").alias("parts"))
    known = rows.join(sizes, "g")
    left = known.select("g", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("part"), F.col("m").alias("a"))
    right = known.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("m").alias("b"))
    return left.join(right, ["g", "part"]).where("a < b").select("a", "b")
