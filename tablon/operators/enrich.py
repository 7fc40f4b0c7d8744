"""Answers of a model for rows that no earlier answer covers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tablon.operators.accumulate import accumulate, fill_blank, pending


class Provider(Protocol):
    """What answers a prompt; made on the driver, sent to the workers."""

    def generate(self, prompt: str) -> str | None: ...


def answers_of(text: str | None) -> list[dict]:
    """Records of an answer: a JSON list, or the first list among an object's values; else none."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return []
    if isinstance(found, dict):
        found = next((v for v in found.values() if isinstance(v, list)), [])
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def enrich(rows: DataFrame, provider: Provider, prompt: str, field: str, batch: int = 20) -> DataFrame:
    """``publicacion_id, valor``: answers for rows (``publicacion_id, texto``), asked in batches within each partition.
    Answers name the row they are for in ``id``; others, repeated ones and invalid ones are left out."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), batch):
                group = part.iloc[start : start + batch]
                payload = [{"id": i, "texto": t} for i, t in zip(group["publicacion_id"], group["texto"])]
                found = answers_of(provider.generate(prompt + json.dumps(payload, ensure_ascii=False)))
                known = {str(x.get("id")): str(x[field]) for x in reversed(found) if x.get(field) is not None}
                yield pd.DataFrame([(i, known[str(i)]) for i in group["publicacion_id"] if str(i) in known], columns=["publicacion_id", "valor"])

    return rows.select("publicacion_id", "texto").mapInPandas(ask, "publicacion_id string, valor string")


def enrich_with_cache(rows: DataFrame, cache: DataFrame, provider: Provider, prompt: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``valor`` from the cache or, where it has none, from the provider; and the cache with the new answers."""
    keys = ["publicacion_id", "descripcion_hash"]
    known = fill_blank(rows, cache, keys, "valor", "valor") if "valor" in rows.columns else rows.join(cache.select(*keys, "valor"), keys, "left")
    new = enrich(pending(known, cache, keys, "valor"), provider, prompt, field)
    fresh = rows.select(*keys).join(new, "publicacion_id").select(*keys, "valor")
    merged = accumulate(cache, fresh, keys)
    return fill_blank(known, fresh, keys, "valor", "valor"), merged.select(*cache.columns)
