"""Connected components of pairwise matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablon.session import cut_lineage

HOT_SHARE = 200  # a vertex with more than 1/200 of all edge ends is hot: there are under 200 of them


def _with_minimum(ends: DataFrame, minima: DataFrame, total: int) -> DataFrame:
    """Each (u, v) with the minimum ``m`` of its u. Vertices that hold much of the edges get theirs
    from a broadcast table of under HOT_SHARE rows, so no task holds all edges of one;
    the others meet by a shuffle join."""
    hot = F.broadcast(minima.where(F.col("n") > max(1, total // HOT_SHARE)).select(F.col("u").alias("hu"), F.col("m").alias("hm")))
    marked = ends.join(hot, F.col("u") == F.col("hu"), "left")
    few = marked.where("hu is not null").select("u", "v", F.col("hm").alias("m"))
    many = marked.where("hu is null").select("u", "v").join(minima.select("u", "m"), "u").select("u", "v", "m")
    return few.unionAll(many)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every vertex's larger neighbours get the least of its neighbourhood instead."""
    ends = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    linked = _with_minimum(ends, minima, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every vertex and its smaller neighbours get the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = _with_minimum(down, minima, total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(minima.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, written, with their number and a hash of all of them, which are told while they are written."""
    seen = Observation()
    written = cut_lineage(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")))
    told = seen.get
    return written, (told["n"], int(told["h"] or 0))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their vertices as bigints in the vertices' order, and the table of both (``id, vertex``). Vertices
    are ordered by ranges, so partitions hold ascending ones, as their numbers are."""
    vertices = edges.select("u").unionAll(edges.select("v")).distinct().orderBy("u")
    names = cut_lineage(vertices.select(F.monotonically_increasing_id().alias("id"), F.col("u").alias("vertex")))
    ids = edges.join(names.toDF("iu", "u"), "u").join(names.toDF("iv", "v"), "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"))
    return ids, names


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex, component``: every vertex of ``pairs`` with the least vertex that it is linked to,
    directly or through others. Vertices may be of any type that can be ordered; others than bigints are
    numbered in their order first, so that rounds shuffle two numbers an edge.

    Large-star and small-star rewrites alternate, each a shuffle by vertex, until the edges are
    those of the round before: then every vertex points at its component's minimum. Rounds grow
    with the logarithm of a chain's length. Each round is written to the checkpoint folder.
    Self pairs, repeated and reversed pairs count once; pairs with a null end are left out,
    and a vertex of self pairs only is alone and doesn't come out. No pairs give no rows.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    plain = isinstance(edges.schema["u"].dataType, T.LongType) and isinstance(edges.schema["v"].dataType, T.LongType)
    names = None
    if not plain:
        edges, names = _numbered(cut_lineage(edges))
    edges, before = _kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        edges, now = _kept(_small_star(_large_star(edges, before[0]), before[0]))
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    labels = stars.unionAll(stars.select(F.col("component").alias("vertex"), "component").distinct())
    if names is None:
        return labels
    own, least = names.toDF("i", "vertex"), names.toDF("j", "component")
    return labels.toDF("i", "j").join(own, "i").join(least, "j").select("vertex", "component")


def listing_groups(listings: DataFrame, pairs: DataFrame, canonical) -> DataFrame:
    """``anuncio_id, grupo_id``: every listing that accepted pairs link with another, and the least
    ``anuncio_id`` of its group. ``canonical`` makes a listing's link from a raw one. A link without
    a listing still joins those on its sides. Listings delivered twice count once."""
    known = (
        listings.where("anuncio_id is not null and enlace is not null")
        .groupBy(canonical(F.col("enlace")).alias("link")).agg(F.min("anuncio_id").alias("id"))
    )
    accepted = (
        pairs.where("aceptado").select(canonical(F.col("enlace_a")).alias("la"), canonical(F.col("enlace_b")).alias("lb"))
        .where("la <> '' and lb <> '' and la <> lb").distinct()
    )

    def vertex(link: Column, id_: Column) -> Column:
        return F.struct(id_.isNull().alias("unlisted"), id_.alias("id"), F.when(id_.isNull(), link).alias("link"))

    ends = (
        accepted.join(known.select(F.col("link").alias("la"), F.col("id").alias("ia")), "la", "left")
        .join(known.select(F.col("link").alias("lb"), F.col("id").alias("ib")), "lb", "left")
        .select(vertex(F.col("la"), F.col("ia")).alias("a"), vertex(F.col("lb"), F.col("ib")).alias("b"))
    )
    groups = connected_components(ends, "a", "b")
    return groups.where("not vertex.unlisted").select(F.col("vertex.id").alias("anuncio_id"), F.col("component.id").alias("grupo_id"))
