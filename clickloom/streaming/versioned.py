"""A table of newest rows per key that a stream keeps up to date, batch by batch.

Each batch adds one run: the rows it changed. Runs of one level are merged into a run of the next once there are ``fan`` of
them, so a reader opens at most ``fan - 1`` runs a level, however many batches there were. A manifest lists the runs;
it is published last, under the next number, so a reader never sees half a batch, and a batch that comes again after a
failure is left out if its manifest is there. Runs that no longer count are deleted one manifest later, when readers of
the manifest before have had their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import _file_system, children

VERSION = "_version"


class VersionedTable:
    """``keys`` identify a row; a later batch's row replaces an earlier one's. Null keys are keys like others."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], fan: int = 4):
        self.spark, self.root, self.keys, self.fan = spark, root.rstrip("/"), list(keys), fan

    def manifest(self) -> dict:
        """The newest published state: its number, the last batch in it, and its runs (path and level, oldest first)."""
        numbers = [int(n.removesuffix(".json")) for n in children(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        if not numbers:
            return {"number": -1, "batch": -1, "runs": [], "gone": []}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{max(numbers)}.json", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        target, fs = _file_system(self.spark, f"{self.root}/manifests/{state['number']}.json")
        draft, _ = _file_system(self.spark, f"{self.root}/manifests/{state['number']}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, target):  # somebody else has published this number
            raise RuntimeError(f"manifest {target} is there already")

    def _newest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys and c != VERSION]
        top = df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, VERSION), VERSION).alias("_row"))
        return top.select(*self.keys, *[f"_row.{c}" for c in (*rest, VERSION)])

    def _write(self, df: DataFrame) -> str:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def put(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch's rows, one for each key; false if the batch is in the table already.

        Such rows are computed all the same, as the engine's own state of the batch only follows from that.
        """
        state = self.manifest()
        if batch <= state["batch"]:
            rows.write.format("noop").mode("overwrite").save()
            return False
        runs = [*state["runs"], {"path": self._write(rows.withColumn(VERSION, F.lit(batch))), "level": 0}]
        gone, level = [], 0
        while sum(r["level"] == level for r in runs) >= self.fan:
            old = [r for r in runs if r["level"] == level]
            merged = self._newest(self.spark.read.parquet(*[r["path"] for r in old]))
            at = runs.index(old[0])
            runs = [r for r in runs if r["level"] != level]
            runs.insert(at, {"path": self._write(merged), "level": level + 1})
            gone += [r["path"] for r in old]
            level += 1
        self._publish({"number": state["number"] + 1, "batch": batch, "runs": runs, "gone": gone})
        for path in state["gone"]:
            place, fs = _file_system(self.spark, path)
            fs.delete(place, True)
        return True

    def read(self) -> DataFrame:
        """The newest row of each key, with its batch in ``_version``."""
        runs = self.manifest()["runs"]
        if not runs:
            raise ValueError(f"no batch has been put into {self.root}")
        return self._newest(self.spark.read.parquet(*[r["path"] for r in runs]))
