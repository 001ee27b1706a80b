"""Registration of queries: a key, the inventory ids it covers, the callable and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    ids: tuple[str, ...]
    run: Query
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def add(self, key: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            if key in self.entries:
                raise ValueError(f"{key} is registered twice")
            self.entries[key] = Entry(key, tuple(ids.split()), run, sql)
            return run

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
