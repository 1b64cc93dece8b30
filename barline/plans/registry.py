"""Registry of queries: name, inventory ids, Spark callable and check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.plans.adapters import ADAPTERS, BASE, EXACT, needed, with_adapters
from barline.session import land, ship


# Derived panels that operators expect as landed files: a plan then scans the few columns
# it needs instead of deriving the panel again at every mention.
LANDED = {"bars": ["ticker", "date"], "market": ["date"], "regime_daily": ["date"]}
_landed: dict[tuple[str, str, str], str] = {}


class Tables:
    """Lazy access to driver tables and adapters: ``t.lineitem``, ``t.bars``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in ADAPTERS:
                self._cache[name] = self._adapter(name)
            else:
                raise AttributeError(name)
        return self._cache[name]

    def _adapter(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if name in LANDED and key in _landed:
            return self.spark.read.parquet(_landed[key])
        df = self._derive(name)
        if name not in LANDED:
            return df
        _landed[key] = land(df, LANDED[name])
        return self.spark.read.parquet(_landed[key])

    def _derive(self, name: str) -> DataFrame:
        """Spark SQL of the adapter over the driver tables and landed panels."""
        bodies = ADAPTERS | EXACT
        body = bodies[name]
        stop = tuple(n for n in LANDED if n != name)
        parts = [n for n in needed(f"FROM {name} ", stop) if n != name]
        text = "".join(
            ("WITH " if i == 0 else ", ") + f"{n} AS ({bodies[n]})" for i, n in enumerate(parts)
        ) + body
        used = {b: getattr(self, b) for b in [*BASE, *stop] if re.search(rf"(FROM|JOIN)\s+{b}\b", text)}
        for b in used:
            text = re.sub(rf"((?:FROM|JOIN)\s+){b}\b", rf"\1{{{b}}} AS {b}", text)
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None, r: str = "", digits: int = 4, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame``.

    ``r`` lists the double columns that are rounded half-even to ``digits`` places on
    both sides: sums of doubles depend on the order an engine adds them in.
    """
    cols = r.split()

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = fn(Tables(spark, sf_dir))
            return df.withColumns({c: F.bround(c, digits) for c in cols}) if cols else df

        text = None
        if sql is not None:
            text = with_adapters(sql, recursive)
            if cols:
                repl = ", ".join(f"round_even(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in cols)
                text = f"SELECT * REPLACE ({repl}) FROM ({text}) AS checked"
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(ids.split()), run, text)
        return fn

    return wrap
