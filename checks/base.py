"""Registry of queries. Each names its output columns and types once; both engines are cast to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.ctes import with_tables
from checks.fixture import Tables
from evengap.operators.skew import shared_folder

# Doubles are compared to nine decimals (f); to six where every row depends on a sum over many rows, whose last digits
# change with the order of addition (h); to three where they are large (g).
_DIGITS = {"f": 9, "h": 6, "g": 3}
_SPARK = {"i": "bigint", "f": "double", "h": "double", "g": "double", "s": "string", "b": "boolean", "t": "timestamp_ntz"}
_DUCK = {"i": "BIGINT", "f": "DOUBLE", "h": "DOUBLE", "g": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP"}
KEY = "date:i trip_id:i stop_sequence:i "


@dataclass(frozen=True)
class Check:
    spec: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    extra: dict[str, str] | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.rsplit(":", 1)) for c in self.spec.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.answer(Tables(spark, sf_dir))

    def answer(self, tables: Tables) -> DataFrame:
        out = []
        for name, kind in self.columns():
            c = F.col(name).cast(_SPARK[kind])
            out.append((F.round(c, _DIGITS[kind]) if kind in _DIGITS else c).alias(name))
        return self.run(tables).select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns():
            c = f'CAST("{name}" AS {_DUCK[kind]})'
            out.append(f"{f'round({c}, {_DIGITS[kind]}) + 0.0' if kind in _DIGITS else c} AS \"{name}\"")
        return with_tables(f"SELECT {', '.join(out)} FROM ({self.sql}) AS answer", self.extra)


CHECKS: dict[str, Check] = {}


def check(name: str, spec: str, sql: str | None = None, **extra: str):
    def register(run: Callable[[Tables], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(spec, run, sql, extra or None)
        return run

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables."""
    return shared_folder(spark)
