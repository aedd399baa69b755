"""Small fixed tables, declared once: as a DataFrame and as a SQL VALUES list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True)
class Literal:
    schema: str
    rows: tuple

    @property
    def names(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    def sql(self) -> str:
        """`(VALUES ...) AS t(...)` without the alias, to be used as a common table expression body."""
        kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}
        types = [kinds[part.split()[1]] for part in self.schema.split(", ")]
        cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(self.names, types, strict=True))
        return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows) + f") AS t({', '.join(self.names)})"
