"""Domain tables as they are stored, in the shape the reports read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelspark.operators.sinks import stored
from parcelspark.schemas import SCHEMAS


class StoredTables:
    """Last versions of the tables below ``root``; a plan made from them keeps reading those versions.

    Stores carry their brand's name, buildings the middle of their outline as a point. Amounts are doubles, as reports
    compute in doubles.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        rows = stored(self.spark, self.root, name)
        return rows.withColumns({f.name: F.col(f.name).cast("double") for f in rows.schema if f.dataType.typeName() == "decimal"})

    @cached_property
    def stores(self) -> DataFrame:
        brands = stored(self.spark, self.root, "store_brands").select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
        return self.__getattr__("stores").join(brands, "brand_id")

    @cached_property
    def buildings(self) -> DataFrame:
        rows = self.__getattr__("buildings")
        middle = lambda axis: F.when(F.size("polygon") > 0, (F.array_min(F.col("polygon")[axis]) + F.array_max(F.col("polygon")[axis])) / 2.0)
        return rows.withColumn("lon", middle("lon")).withColumn("lat", middle("lat"))
