"""State of listings over repeated runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablon.functions.identity import canonical_link
from tablon.operators.accumulate import keep_last
from tablon.session import cut_lineage


@dataclass(frozen=True)
class Policy:
    """When missing listings are retired. ``collapse_share`` and ``collapse_base`` guard against runs that
    found hardly anything; ``stale_days`` retires long unseen ones after partial runs (0: never)."""

    absences: int = 3
    collapse_share: float = 0.4
    collapse_base: int = 20
    stale_days: int = 0


@dataclass(frozen=True)
class Run:
    """``mutate`` says whether absences count; unstated, they do unless the quality is degraded. A rerun counts none."""

    at: datetime
    complete: bool = True
    quality: str = "ok"
    rerun: bool = False
    mutate: bool | None = None

    def counts(self) -> bool:
        stated = self.mutate if self.mutate is not None else self.quality.strip().lower() not in DEGRADED
        return stated and not self.rerun


DEGRADED = ("degradado", "degradada")  # fixed values: qualities whose absences prove nothing


def prepared(batch: DataFrame, scope: list[str], order: str | None = None) -> DataFrame:
    """Rows with a canonical link, the last one of each link within its scope; blank links are dropped."""
    rows = batch.withColumn("enlace", canonical_link(F.col("enlace"))).where("enlace <> ''")
    kept = keep_last(rows, [*scope, "enlace"], [F.col(order)] if order else [])
    return kept.drop(order) if order else kept


def apply_run(
    state: DataFrame, batch: DataFrame, run: Run, policy: Policy, scope: list[str], order: str | None = None, covers: list[dict] | None = None
) -> DataFrame:
    """The state after a run: rows of ``state`` and ``batch`` with ``estado_anuncio`` (``nuevo``, ``repetido``,
    null for the others) and the counters.

    One full outer join on scope and link. Listings that are seen get all values of the batch, nulls
    too, and become active again. Of those that aren't, active ones of a scope that the run covers
    have one absence more and are retired at ``policy.absences``, unless the run is degraded, partial or a
    rerun, or the guard holds: a scope with at least ``collapse_base`` active rows, after the run's
    own, of which it saw under ``collapse_share``. The run covers the scopes of ``covers`` (values by
    column; so an empty complete run has all of a scope absent), else those that ``batch`` has rows of.
    Scopes' nulls are equal. Either side may be empty.
    """
    about = {"at": run.at, "complete": run.complete, "quality": run.quality, "rerun": run.rerun, "mutate": run.counts()}
    if covers is None:
        scopes = batch.select(*scope).distinct()
    else:
        fields = T.StructType([batch.schema[k] if k in batch.columns else state.schema[k] for k in scope])
        scopes = batch.sparkSession.createDataFrame([tuple(c.get(k) for k in scope) for c in covers], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    runs = scopes.select(*scope, *[F.lit(v).alias(k) for k, v in about.items()])
    return apply_runs(state, batch, runs, policy, scope, order)


def apply_runs(state: DataFrame, batch: DataFrame, runs: DataFrame, policy: Policy, scope: list[str], order: str | None = None, mark: str | None = None) -> DataFrame:
    """``apply_run`` for runs of several scopes at a time: ``runs`` (scope, at, complete, quality, rerun, and mutate
    if stated) has at most one for each scope, which it covers with or without rows; ``batch`` has rows of these scopes.
    With ``mark`` a column of that name tells the rows that are absent (or retired as stale) by this run."""
    sound = ~F.coalesce(F.lower(F.trim("quality")).isin(*DEGRADED), F.lit(False))
    mutates = F.coalesce(F.col("mutate"), sound) if "mutate" in runs.columns else sound
    # How many scopes there are isn't bounded, so the planner chooses by size how they are joined.
    ran = runs.select(*scope, F.col("at").cast("timestamp_ntz").alias("__at"), F.col("complete").alias("__complete"), (~F.col("rerun") & mutates).alias("__counts"))
    x, y = prepared(batch, scope, order).alias("x"), ran.select(*scope, "__at").alias("y")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in scope]
    new = x.join(y, same, "left").select("x.*", F.col("y.__at").alias("__at"), F.lit(True).alias("__in"))
    old = state.withColumn("__was", F.lit(True))
    values = [c for c in new.columns if c not in (*scope, "enlace", "__at", "__in")]
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*scope, "enlace")]
    seen, known = F.col("__in").isNotNull(), F.col("__was").isNotNull()
    pick = lambda c: F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}") if c in state.columns else F.lit(None))
    others = [c for c in state.columns if c not in (*scope, "enlace", *values, "primera_vez_visto", "ultima_vez_visto", "ausencias_consecutivas", "activo", "fecha_baja")]
    merged = a.join(b, on, "full").select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in (*scope, "enlace")],
        *[pick(c).alias(c) for c in values], *[F.col(f"a.{c}").alias(c) for c in others],
        F.coalesce(F.col("a.primera_vez_visto"), F.col("b.__at")).alias("primera_vez_visto"),
        F.when(seen, F.col("b.__at")).otherwise(F.col("a.ultima_vez_visto")).alias("ultima_vez_visto"),
        F.when(seen, 0).otherwise(F.col("a.ausencias_consecutivas")).alias("ausencias_consecutivas"),
        F.when(seen, True).otherwise(F.col("a.activo")).alias("activo"),
        F.when(~seen, F.col("a.fecha_baja")).alias("fecha_baja"),
        F.when(seen & known, "repetido").when(seen, "nuevo").alias("estado_anuncio"),
    )
    marked = _with_scope(merged, ran, scope)
    sizes = marked.where("__counts and __complete and activo").groupBy(*scope).agg(F.count("*").alias("__base"), F.count("estado_anuncio").alias("__present"))
    marked = _with_scope(marked, sizes, scope)
    missing = F.col("__counts") & F.col("activo") & F.col("estado_anuncio").isNull()
    guard = (F.col("__base") >= policy.collapse_base) & (F.col("__present") < F.lit(policy.collapse_share) * F.col("__base"))
    absent = F.coalesce(missing & F.col("__complete") & ~guard, F.lit(False))
    count = F.when(absent, F.col("ausencias_consecutivas") + 1).otherwise(F.col("ausencias_consecutivas"))
    limit = F.col("__at") - F.make_interval(days=F.lit(policy.stale_days))
    stale = F.coalesce(missing & ~F.col("__complete") & (F.col("ultima_vez_visto") < limit), F.lit(False)) if policy.stale_days else F.lit(False)
    done = marked.withColumns({"__count": count, "__gone": (absent & (count >= policy.absences)) | stale})
    extra = [F.coalesce(absent | stale, F.lit(False)).alias(mark)] if mark else []
    return done.select(*extra, *[
        F.col("__count").alias(c) if c == "ausencias_consecutivas"
        else F.when(F.col("__gone"), False).otherwise(F.col(c)).alias(c) if c == "activo"
        else F.when(F.col("__gone"), F.col("__at").cast("date")).otherwise(F.col(c)).alias(c) if c == "fecha_baja"
        else F.col(c) for c in merged.columns
    ])


def _with_scope(rows: DataFrame, facts: DataFrame, scope: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``facts`` (a row for each scope); nulls of a scope are equal."""
    a, b = rows.alias("l"), facts.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in scope]
    return a.join(b, on, "left").select("l.*", *[F.col(f"r.{c}") for c in facts.columns if c not in scope])


def fold_runs(rows: DataFrame, runs: DataFrame, state: DataFrame, policy: Policy, scope: list[str], order: str | None = None) -> DataFrame:
    """The state after all ``runs`` (corrida_id, scope, at, complete, quality, rerun), each scope's in order of time.
    The first runs of all scopes are applied at once, then the second ones: as many rounds as the longest scope
    has runs, each written to the checkpoint folder. ``estado_anuncio`` is of the scope's last run."""
    return _folded(rows, runs, state, policy, scope, order)[0]


def fold_log(rows: DataFrame, runs: DataFrame, state: DataFrame, policy: Policy, scope: list[str], order: str | None = None) -> DataFrame:
    """The log of ``fold_runs``: ``corrida_id, n_total, n_nuevos, n_repetidos, n_desaparecidos`` of every run, also of those
    that found nothing."""
    return _folded(rows, runs, state, policy, scope, order)[1]


def _folded(rows: DataFrame, runs: DataFrame, state: DataFrame, policy: Policy, scope: list[str], order: str | None) -> tuple[DataFrame, DataFrame]:
    numbered = cut_lineage(runs.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy("at", "corrida_id"))))
    last = numbered.agg(F.max("__n")).first()[0] or 0
    state = state.withColumn("estado_anuncio", F.lit(None).cast("string"))
    zero = F.lit(0).cast("bigint")
    logs = [numbered.select("corrida_id", *[zero.alias(c) for c in ("n_total", "n_nuevos", "n_repetidos", "n_desaparecidos")])]
    for n in range(1, last + 1):
        now = numbered.where(F.col("__n") == n)
        batch = rows.join(now.select("corrida_id"), "corrida_id").drop("corrida_id")
        after = apply_runs(state.withColumnRenamed("estado_anuncio", "__estado"), batch, now, policy, scope, order, "__falta")
        after = cut_lineage(_with_scope(after, now.select(*scope, F.col("corrida_id").alias("__now")), scope))
        seen = F.col("estado_anuncio")
        logs.append(after.where("__now is not null").groupBy(F.col("__now").alias("corrida_id")).agg(
            F.count(seen).alias("n_total"), F.count_if(seen == "nuevo").alias("n_nuevos"), F.count_if(seen == "repetido").alias("n_repetidos"), F.count_if("__falta").alias("n_desaparecidos")
        ))
        kept = F.when(F.col("__now").isNotNull(), seen).otherwise(F.col("__estado"))
        state = after.withColumn("estado_anuncio", kept).drop("__estado", "__now", "__falta")
    log = reduce(DataFrame.unionByName, logs).groupBy("corrida_id").agg(*[F.sum(c).alias(c) for c in ("n_total", "n_nuevos", "n_repetidos", "n_desaparecidos")])
    return state, log


def closed_form(rows: DataFrame, runs: DataFrame, scope: list[str], absences: int) -> DataFrame:
    """``scope, enlace, primera, ultima, ausencias, activo`` after all runs at once, where every run is
    complete and no guard holds: absences are the runs of the scope since the link was last seen, up to
    ``absences``. ``rows``: (run, scope, enlace) as seen; ``runs``: (run, scope, at)."""
    w = Window.partitionBy(*scope).orderBy("fecha", "corrida_id")
    numbered = runs.withColumn("n", F.row_number().over(w)).select(*scope, "corrida_id", "fecha", "n")
    totals = numbered.groupBy(*scope).agg(F.max("n").alias("total"))
    seen = rows.select(*scope, "corrida_id", canonical_link(F.col("enlace")).alias("enlace")).where("enlace <> ''")
    spans = seen.join(numbered, [*scope, "corrida_id"]).groupBy(*scope, "enlace").agg(
        F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"), F.max("n").alias("last")
    )
    count = F.least(F.lit(absences), F.col("total") - F.col("last")).cast("int")
    return spans.join(totals, scope).select(*scope, "enlace", "primera", "ultima", count.alias("ausencias"), (count < absences).alias("activo"))


def known_run(runs: DataFrame, source_id: str, scope: dict[str, str | None]) -> bool:
    """Whether the log has a run of this source id in this scope (nulls are equal)."""
    same = F.col("id_fuente") == source_id
    for k, v in scope.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return not runs.where(same).limit(1).isEmpty()


def run_statistics(
    before: DataFrame, after: DataFrame, scope: list[str], run: Run | None = None, policy: Policy | None = None, batch_rows: int | None = None, source_id: str | None = None
) -> DataFrame:
    """One row about a run, from the state before and after it: ``total``, ``nuevos``, ``repetidos``, ``desaparecidos``
    (newly absent or retired), ``dados_de_baja``, ``duplicados_descartados`` (of ``batch_rows``, if given),
    ``omitido_por_rerun`` (false: a run that is skipped has no state), ``mutacion_desaparecidos``, ``listado_completo``,
    ``colapso_listado`` (whether the guard held in any scope) and ``id_fuente``. Both states are those of the run's scopes."""
    run, policy = run or Run(datetime.min), policy or Policy()
    keys = [*scope, "enlace"]
    a, b = after.alias("a"), before.select(*keys, "ausencias_consecutivas", "activo").alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    retired = F.coalesce(F.col("b.activo") & ~F.col("a.activo"), F.lit(False))
    absent = retired | F.coalesce(F.col("a.ausencias_consecutivas") > F.col("b.ausencias_consecutivas"), F.lit(False))
    seen, was = F.col("a.estado_anuncio"), F.coalesce(F.col("b.activo"), F.lit(False)) | F.col("a.estado_anuncio").isNotNull()
    per = both.groupBy(*[F.col(f"a.{k}").alias(k) for k in scope]).agg(
        F.count(seen).alias("total"), F.count_if(seen == "nuevo").alias("nuevos"), F.count_if(seen == "repetido").alias("repetidos"),
        F.count_if(absent).alias("desaparecidos"), F.count_if(retired).alias("dados_de_baja"), F.count_if(was).alias("__base"),
    )
    counts = run.counts()
    held = (F.col("__base") >= policy.collapse_base) & (F.col("total") < F.lit(policy.collapse_share) * F.col("__base"))
    one = per.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "nuevos", "repetidos", "desaparecidos", "dados_de_baja")],
        F.coalesce(F.max(held), F.lit(False)).alias("__held"),
    )
    return one.select(
        "total", "nuevos", "repetidos", "desaparecidos", "dados_de_baja", (F.lit(batch_rows).cast("bigint") - F.col("total")).alias("duplicados_descartados"),
        F.lit(False).alias("omitido_por_rerun"), F.lit(counts).alias("mutacion_desaparecidos"), F.lit(run.complete).alias("listado_completo"),
        (F.col("__held") & F.lit(counts and run.complete)).alias("colapso_listado"), F.lit(source_id).cast("string").alias("id_fuente"),
    )


def skipped_statistics(batch: DataFrame, scope: list[str], order: str | None, source_id: str) -> DataFrame:
    """The row about a run that the log has already: no counts but those of repeats within its batch."""
    kept = prepared(batch, scope, order).agg(F.count("*").alias("k"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("nuevos", "repetidos", "desaparecidos", "dados_de_baja")]
    return batch.agg(F.count("*").alias("n")).crossJoin(kept).select(  # one row each
        *none, (F.col("n") - F.col("k")).alias("duplicados_descartados"), F.lit(True).alias("omitido_por_rerun"),
        F.lit(False).alias("mutacion_desaparecidos"), F.lit(source_id).alias("id_fuente"),
    )


def stale_listings(state: DataFrame, at: Column, days: int) -> DataFrame:
    """Active listings that were last seen more than ``days`` before ``at`` (a column of ``state`` or a constant)."""
    return state.where(F.col("activo") & (F.col("ultima_vez_visto") < at - F.make_interval(days=F.lit(days))))


def known_source_ids(runs: DataFrame, scope: list[str]) -> DataFrame:
    """``runs`` with ``ya_registrada``: whether an earlier run (by ``fecha``, ``corrida_id``) of the scope has the same
    source id. Runs without one are always new."""
    w = Window.partitionBy(*scope, "id_fuente").orderBy("fecha", "corrida_id")
    return runs.withColumn("ya_registrada", F.col("id_fuente").isNotNull() & (F.row_number().over(w) > 1))


def first_seen_counts(rows: DataFrame, runs: DataFrame, scope: list[str]) -> DataFrame:
    """``corrida_id, n_total, n_nuevos, n_repetidos``: the log's counts of every run (``runs``: corrida_id, scope, n, the
    number of a run within its scope) from the links that it has (``rows``: corrida_id, enlace)."""
    links = rows.select("corrida_id", canonical_link(F.col("enlace")).alias("enlace")).where("enlace <> ''").distinct().join(runs.select("corrida_id", *scope, "n"), "corrida_id")
    first = links.groupBy(*scope, "enlace").agg(F.min("n").alias("__first"))
    a, b = links.alias("a"), first.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*scope, "enlace")])
    return both.groupBy("corrida_id").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("__first") == F.col("n")).alias("n_nuevos"), F.count_if(F.col("__first") < F.col("n")).alias("n_repetidos")
    )
