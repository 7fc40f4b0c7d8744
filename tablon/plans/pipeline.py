"""One run from raw records to state and report."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablon.functions.dates import with_periods
from tablon.functions.identity import publication_id
from tablon.functions.text import content_hash
from tablon.operators.lifecycle import Policy, Run, apply_run, known_run, run_statistics
from tablon.operators.quality import quality_gate
from tablon.operators.validate import quarantine
from tablon.session import cut_lineage
from tablon.sources.state import ScopedTable, VersionedTable, append_log

SCOPE = ["sector", "portal", "tipo_operacion"]


@dataclass(frozen=True)
class RunRequest:
    """What a run is about. ``source_id`` makes it idempotent."""

    at: datetime
    corrida_id: int
    source_id: str
    sector: str
    portal: str
    operation: str
    complete: bool = True
    allow_rerun: bool = False
    least: dict[str, float] = field(default_factory=lambda: {"enlace": 0.9, "titulo": 0.5})


def planned_runs(portals: list[str], operations: list[str | None], portal: str = "todos", operation: str = "todas") -> list[tuple[str, str | None]]:
    """The (portal, operation) of each run, every portal's in turn: all of them or the one that is named; a portal without
    operations has one run."""
    chosen = portals if portal == "todos" else [portal]
    of_each = (operations if operation == "todas" else [operation]) if operations else [None]
    return [(p, o) for p in chosen for o in of_each]


def routed(rows: DataFrame, verdict: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``destino``: ``vigentes`` where the verdict on their keys is fit, else ``degradadas``."""
    fit = verdict.select(*keys, F.col("apta").alias("__fit"))
    return rows.join(fit, keys, "left").withColumn("destino", F.when(F.col("__fit"), "vigentes").otherwise("degradadas")).drop("__fit")


def clean(raw: DataFrame, request: RunRequest) -> DataFrame:
    """Raw records with the run's scope, ids, hashes and periods; records without any value are dropped."""
    scoped = raw.dropna("all").withColumns(
        {"sector": F.lit(request.sector), "portal": F.lit(request.portal), "tipo_operacion": F.lit(request.operation), "fecha_extraccion": F.lit(request.at).cast("timestamp_ntz")}
    )
    posting = F.col("id_portal") if "id_portal" in raw.columns else F.lit(None)
    text = F.col("descripcion") if "descripcion" in raw.columns else F.lit(None).cast("string")
    keyed = scoped.withColumns(
        {
            "publicacion_id": publication_id(F.col("sector"), F.col("portal"), F.col("tipo_operacion"), F.col("enlace"), posting),
            "descripcion_hash": content_hash(text),
        }
    )
    return with_periods(keyed, "fecha_publicacion") if "fecha_publicacion" in raw.columns else keyed


def process_run(raw: DataFrame, request: RunRequest, state: VersionedTable | ScopedTable, log: DataFrame, log_path: str, degraded_path: str, policy: Policy, columns: list[str], order: str | None = None) -> str:
    """Runs all stages; the outcome is ``ya_registrado``, ``sin_datos``, ``degradado``, ``advertencia`` or ``ok``.

    A source id that the log has in this scope changes nothing. Degraded runs are written to
    ``degraded_path`` and leave the state as it was; so do rows with errors of good ones. The state's new version
    is written before the log's row, so a run that dies between is repeated and finds its rows there. Of a
    ``ScopedTable`` only the run's scope is read and rewritten.
    """
    scope = {"sector": request.sector, "portal": request.portal, "tipo_operacion": request.operation}
    again = known_run(log, request.source_id, scope)
    if again and not request.allow_rerun:
        return "ya_registrado"
    cleaned = cut_lineage(clean(raw, request))
    verdict = quality_gate(cleaned, request.least).first()["estado"]  # one row decides the route
    if verdict in ("sin_datos", "degradado"):
        cleaned.write.mode("overwrite").parquet(f"{degraded_path}/corrida={request.corrida_id}")
        return verdict
    good, bad = quarantine(cleaned)
    if not bad.limit(1).isEmpty():
        bad.write.mode("overwrite").parquet(f"{degraded_path}/errores={request.corrida_id}")
    rows = good.select(*SCOPE, "enlace", *columns, *([order] if order else []))
    table = state.part(scope) if isinstance(state, ScopedTable) else state
    before = table.read()
    run = Run(request.at, request.complete, verdict, again)
    after = cut_lineage(apply_run(before, rows, run, policy, SCOPE, order, [scope]))
    counts = cut_lineage(run_statistics(before, after, SCOPE, run, policy, source_id=request.source_id))
    table.write(after.drop("estado_anuncio"))
    entry = {"corrida_id": request.corrida_id, "fecha": request.at, **scope, "id_fuente": request.source_id, "listado_completo": request.complete, "estado_calidad": verdict}
    append_log(counts.select(*[F.lit(v).alias(k) for k, v in entry.items()], *[F.col(c).alias(f"n_{c}") for c in ("total", "nuevos", "repetidos", "desaparecidos")]), log_path)
    return verdict
