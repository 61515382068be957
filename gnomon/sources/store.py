"""The live store: orders, fills and positions as tables behind one interface, and stored back-test runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .readers import exists

#: Column lists (fixed values).
TABLES = {
    "orders": "order_id string, model_id string, asset string, side string, type string, quantity double, price double, status string, created_at timestamp",
    "fills": "fill_id string, order_id string, asset string, quantity double, price double, commission double, venue string, filled_at timestamp",
    "positions": "model_id string, asset string, quantity double, avg_price double, realized_pnl double, updated_at timestamp",
}
KEYS = {"orders": ["order_id"], "fills": ["fill_id"], "positions": ["model_id", "asset"]}


class LiveStore:
    """Tables in a folder; every write makes a new version, and the newest complete one is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return []
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(x.getName()[1:]) for x in names if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        v = self._versions(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/v{v[-1]}") if v else self.spark.createDataFrame([], TABLES[name])

    def _write(self, name: str, df: DataFrame) -> None:
        v = self._versions(name)
        df.write.parquet(f"{self.folder}/{name}/v{v[-1] + 1 if v else 0}")

    def put(self, name: str, rows: DataFrame) -> None:
        """Upsert by the table's key."""
        self._write(name, sinks.upsert(self.read(name), rows.select(*self.read(name).columns), keys=KEYS[name], merge={}))

    def orders(self, model_id: str | None = None, status: str | None = None) -> DataFrame:
        out = self.read("orders")
        for column, value in (("model_id", model_id), ("status", status)):
            out = out.where(F.col(column) == value) if value is not None else out
        return out

    def set_order_status(self, order_id: str, status: str) -> None:
        self._write("orders", self.read("orders").withColumn("status", F.when(F.col("order_id") == order_id, F.lit(status)).otherwise(F.col("status"))))


def list_runs(runs: DataFrame, model: str | None = None, limit: int = 20) -> DataFrame:
    """The newest stored back-test runs, of one model if it is given."""
    rows = runs if model is None else runs.where(F.col("model") == model)
    return rows.orderBy(F.desc("hist_id"), "base_id").limit(limit)
