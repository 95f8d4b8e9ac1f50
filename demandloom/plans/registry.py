"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .context import Context
from .oracle_tables import with_tables


@dataclass(frozen=True)
class Entry:
    build: Callable[[Context], DataFrame]
    sql: str | None
    floats: dict[str, tuple[int, float]]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Context(spark, sf_dir))
        return df.withColumns({c: F.round(F.col(c) + s, d) for c, (d, s) in self.floats.items()}) if self.floats else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql
        if self.floats:
            rounded = ", ".join(f'round(CAST("{c}" AS DOUBLE) + {s!r}, {d}) AS "{c}"' for c, (d, s) in self.floats.items())
            body = f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) AS q"
        return with_tables(body)


REGISTRY: dict[str, Entry] = {}


def _floats(spec: str) -> dict[str, tuple[int, float]]:
    """``"a b:2 c:6~"`` to (digits, shift) per column; 6 digits unless given.

    ``~`` marks recursive decimal weights: their values end exactly on a rounding border, so both sides are
    shifted off it by a fraction of the last digit.
    """
    out = {}
    for item in spec.split():
        name, _, digits = item.partition(":")
        places = int(digits.rstrip("~") or 6)
        out[name] = (places, 0.037 * 10.0**-places if digits.endswith("~") else 0.0)
    return out


def query(name: str, sql: str | None = None, floats: str = ""):
    """Register a query; listed float columns are rounded on both sides before they are compared."""

    def register(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Entry(build, sql, _floats(floats))
        return build

    return register
