"""Where research data comes from: anything that gives these three tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from barline.sources import files


class Provider(Protocol):
    def constituents(self) -> DataFrame: ...

    def fundamentals(self) -> DataFrame: ...

    def prices(self) -> DataFrame: ...


@dataclass(frozen=True)
class FolderProvider:
    """Landed files under one folder: ``constituents``, ``fundamentals`` and ``prices`` (.parquet)."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return files.read_dated(self.spark, f"{self.folder}/{name}.parquet")

    def constituents(self) -> DataFrame:
        return files.clean_keys(self._table("constituents"))

    def fundamentals(self) -> DataFrame:
        return files.clean_keys(self._table("fundamentals"))

    def prices(self) -> DataFrame:
        return self._table("prices")
