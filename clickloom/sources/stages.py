"""Stage tables: read a stage when it has been written, else compute and write it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from clickloom.session import code_print, fresh_dir, is_complete, shared_dir, tables_print
from clickloom.sources.writers import partitioned


class StageStore:
    """Named Parquet tables under one shared folder.

    A stage counts as present when its write was committed (the success marker is there) and it has the
    asked columns, so a run that stopped half way resumes with the stages it had finished.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or fresh_dir(spark, "stages")

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> StageStore:
        """The store of a folder of tables: one root for the same files and the same code, so later runs find the stages."""
        return cls(spark, f"{shared_dir(spark).rstrip('/')}/stages-{tables_print(spark, folder)}-{code_print()[:12]}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, columns: Sequence[str] = ()) -> DataFrame | None:
        if not is_complete(self.spark, self.path(name)):
            return None
        df = self.spark.read.parquet(self.path(name))
        return df if set(columns) <= set(df.columns) else None

    def get(
        self,
        name: str,
        compute: Callable[[], DataFrame],
        columns: Sequence[str] = (),
        partition_by: Sequence[str] = (),
    ) -> DataFrame:
        found = self.read(name, columns)
        if found is not None:
            return found
        if partition_by:
            partitioned(compute(), self.path(name), partition_by)
        else:
            compute().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))
