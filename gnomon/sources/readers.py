"""Readers: files with a cache, documents, captures, synthetic series, and a provider as a Spark data source."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

OHLCV = "date date, open double, high double, low double, close double, volume long"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by the file system that Spark reads it with."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_parquet(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at a path; computed and written first where it isn't there."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price files with a header; the ticker is the file's name."""
    rows = spark.read.csv(path, header=True, schema=OHLCV)
    return rows.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1))


def pairs_json(spark: SparkSession, path: str, top: int) -> DataFrame:
    """Pairs of a result file, each unordered pair once with its best score, the best ``top`` of them."""
    rows = spark.read.schema("target string, hedge string, score double").json(path, multiLine=True)
    key = F.array_sort(F.array("target", "hedge"))
    best = rows.groupBy(key.alias("pair")).agg(F.max_by(F.struct("target", "hedge", "score"), "score").alias("b"))
    return best.select("b.*").orderBy(F.desc("score"), "target").limit(top)


def experiments_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Records of markdown documents: ``title, fields, bullets, tables`` for each second-level heading."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    parts = docs.select("file", F.posexplode(F.split("text", r"(?m)^## ")).alias("n", "part")).where("n > 0")
    lines = F.split("part", "\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    pairs = F.filter(body, lambda x: x.rlike(r"^\*\*[^*]+:?\*\*:?\s*\S"))
    fields = F.map_from_entries(
        F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_extract(x, r"^\*\*([^*]+)\*\*", 1), ":$", "")).alias("key"), F.trim(F.regexp_extract(x, r"^\*\*[^*]+\*\*:?\s*(.*)$", 1)).alias("value"))))
    )
    bullets = F.transform(F.filter(body, lambda x: x.rlike(r"^\s*[-*] ")), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*] ", "")))
    cells = F.transform(F.filter(body, lambda x: x.rlike(r"^\|.*\|\s*$") & ~x.rlike(r"^\|[\s:|-]+\|\s*$")), lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)))
    return parts.select("file", "n", F.trim(F.element_at(lines, 1)).alias("title"), fields.alias("fields"), bullets.alias("bullets"), cells.alias("tables"))


def captures(spark: SparkSession, path: str, delimiter: str = "=====") -> DataFrame:
    """Blocks of a capture file: ``header`` (first line) and ``payload``."""
    docs = spark.read.text(path, wholetext=True)
    blocks = docs.select(F.posexplode(F.split("value", rf"(?m)^{delimiter}.*\n?")).alias("n", "block")).where(F.trim("block") != "")
    return blocks.select("n", F.trim(F.substring_index("block", "\n", 1)).alias("header"), F.regexp_replace(F.regexp_replace("block", r"^[^\n]*\n?", ""), r"\s+$", "").alias("payload"))


# --- synthetic ------------------------------------------------------------------------------------------------


def _normal(*seeds: Column) -> Column:
    """A standard normal number hashed from columns, the same at every evaluation."""
    unit = lambda salt: (F.pmod(F.xxhash64(*seeds, F.lit(salt)), F.lit(2**52)).cast("double") + 0.5) / 2.0**52
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))


def random_walks(spark: SparkSession, assets: int, rows: int, *, seed: int = 42, start: float = 100.0, vol: float = 0.02, drift: float = 0.0) -> DataFrame:
    """Geometric walks ``asset, t, price``; every number follows from seed, asset and time alone."""
    t = spark.range(assets * rows).select((F.col("id") / rows).cast("long").alias("asset"), (F.col("id") % rows).alias("t"))
    step = F.when(F.col("t") > 0, drift + vol * _normal(F.lit(seed), F.col("asset"), F.col("t"))).otherwise(0.0)
    w = Window.partitionBy("asset").orderBy("t")
    return t.withColumn("price", F.lit(start) * F.exp(F.sum(step).over(w)))


def cointegrated(walks: DataFrame, *, leader: int = 0, beta: float = 0.8, noise: float = 0.5, seed: int = 7) -> DataFrame:
    """A follower of one walk: ``t, leader, follower``."""
    base = walks.where(F.col("asset") == leader)
    return base.select("t", F.col("price").alias("leader"), (beta * F.col("price") + noise * _normal(F.lit(seed), F.col("t"))).alias("follower"))


def synthetic_bars(walks: DataFrame, first_day: str = "2023-01-03") -> DataFrame:
    """Daily bars around walks, weekdays only: ``ticker, date, open, high, low, close, volume``."""
    n = F.col("t")
    day = F.date_add(F.to_date(F.lit(first_day)), (n + 2 * F.floor((n + F.weekday(F.to_date(F.lit(first_day)))) / 5)).cast("int"))
    gap = F.abs(_normal(F.lit(5), F.col("asset"), n)) * 0.005 + 0.001
    opened = F.col("price") * (1 + 0.003 * _normal(F.lit(6), F.col("asset"), n))
    return walks.select(F.concat(F.lit("T"), F.col("asset").cast("string")).alias("ticker"), day.alias("date"), opened.alias("open"), (F.greatest(opened, "price") * (1 + gap)).alias("high"), (F.least(opened, "price") * (1 - gap)).alias("low"), F.col("price").alias("close"), (F.pmod(F.xxhash64("asset", "t"), F.lit(900_000)) + 100_000).alias("volume"))


# --- provider -------------------------------------------------------------------------------------------------


class _Ticker(InputPartition):
    def __init__(self, ticker: str):
        super().__init__(ticker)
        self.ticker = ticker


class PriceProvider(DataSource):
    """``spark.read.format("gnomon_prices").option("tickers", "A,B").option("rows", 100)``: one partition for each ticker.

    A provider for real prices overrides ``fetch``.
    """

    @classmethod
    def name(cls) -> str:
        return "gnomon_prices"

    def schema(self) -> str:
        return "ticker string, t long, price double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tickers = [t for t in options.get("tickers", "").split(",") if t]
        self.rows, self.seed = int(options.get("rows", 252)), int(options.get("seed", 42))

    def partitions(self) -> list[InputPartition]:
        return [_Ticker(t) for t in self.tickers]

    def read(self, partition: InputPartition):
        rng = np.random.default_rng([self.seed, *partition.ticker.encode()])
        walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, self.rows)))
        yield from ((partition.ticker, t, float(p)) for t, p in enumerate(walk))


def cascade(wanted: DataFrame, layers: list[DataFrame], *, keys: list[str]) -> DataFrame:
    """Each wanted key from the first layer that has it."""
    found, left = None, wanted
    for layer in layers:
        hit = left.join(layer, keys)
        found = hit if found is None else found.unionByName(hit)
        left = left.join(layer.select(*keys).distinct(), keys, "left_anti")
    return found


def membership_intervals(path_rows: DataFrame, current: DataFrame, **columns) -> DataFrame:
    from ..operators.temporal import reversed_membership

    return reversed_membership(path_rows, current, **columns)


def book_features(df: DataFrame, levels: int = 10) -> DataFrame:
    """Book snapshots with flat levels ``bid_px_i, bid_sz_i, ask_px_i, ask_sz_i`` as arrays, with mid, spread, volumes and imbalance."""
    side = lambda s: F.array(*(F.struct(F.col(f"{s}_px_{i}").alias("px"), F.col(f"{s}_sz_{i}").alias("sz")) for i in range(1, levels + 1)))
    rows = df.withColumn("bids", side("bid")).withColumn("asks", side("ask"))
    vol = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x["sz"], F.lit(0.0)))
    bid, ask = F.col("bids")[0]["px"], F.col("asks")[0]["px"]
    rows = rows.withColumn("mid", (bid + ask) / 2).withColumn("spread", ask - bid).withColumn("bid_volume", vol("bids")).withColumn("ask_volume", vol("asks"))
    total = F.col("bid_volume") + F.col("ask_volume")
    return rows.withColumn("spread_bps", F.col("spread") / F.col("mid") * 10_000).withColumn("imbalance", F.when(total > 0, (F.col("bid_volume") - F.col("ask_volume")) / total).otherwise(0.0))
