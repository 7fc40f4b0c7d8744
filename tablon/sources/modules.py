"""Python sources as a table: what they import, and modules that nothing imports."""

from __future__ import annotations

import ast
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _imports_of(source: str | None) -> list[str]:
    """Dotted names that a source imports, modules and their symbols; none if it can't be parsed."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return sorted(names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _imports(sources: pd.Series) -> pd.Series:
    return sources.map(_imports_of)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``modulo, fuente``: every ``.py`` file below ``root`` with its dotted name. A tree of sources is small and lies beside the
    driver, which reads it; Spark's own listing passes over names such as ``__init__.py``."""
    rows = []
    for path in sorted(Path(root).rglob("*.py")):
        name = ".".join(path.relative_to(root).with_suffix("").parts)
        rows.append((name, path.read_text(encoding="utf-8", errors="replace")))
    return spark.createDataFrame(rows, "modulo string, fuente string")


def imported_names(files: DataFrame) -> DataFrame:
    """``importado``: distinct dotted names that any of ``files`` (``source_files``) imports."""
    return files.select(F.explode(_imports("fuente")).alias("importado")).distinct()


def orphan_modules(files: DataFrame) -> DataFrame:
    """``modulo``: modules that no file imports: neither they, nor a name below theirs, nor any name that ends in
    their last part. ``__init__`` modules don't count. Each import is exploded to its beginnings and its last
    part, so modules are told by two equi-joins."""
    names = imported_names(files)
    parts = F.split("importado", r"\.")
    starts = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("modulo"))
    ends = names.where(F.size(parts) > 1).select(F.element_at(parts, -1).alias("__fin"))
    own = files.select("modulo", F.element_at(F.split("modulo", r"\."), -1).alias("__fin")).where("__fin <> '__init__'")
    return own.join(starts, "modulo", "left_anti").join(ends, "__fin", "left_anti").select("modulo")
