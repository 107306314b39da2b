"""Small literal tables, the same in Spark and as SQL VALUES."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return f"[{', '.join(map(_sql, value))}]::VARCHAR[]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value}::DOUBLE" if isinstance(value, float) else str(value)


@dataclass(frozen=True)
class Inline:
    schema: str
    rows: tuple

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    @property
    def sql(self) -> str:
        rows = ", ".join(f"({', '.join(map(_sql, r))})" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS inline_rows({', '.join(self.columns)}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
