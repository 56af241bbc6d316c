"""Bundles: published units, models' side tables and run logs, on any Hadoop file system."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Bundle:
    """Units by level, optional GeoJSON by level, and metadata: `save` writes units as Parquet, the rest as text."""

    units: DataFrame
    meta: dict
    geo: dict[str, DataFrame] | None = None

    def save(self, path: str) -> None:
        spark = self.units.sparkSession
        self.units.write.mode("overwrite").parquet(f"{path}/units")
        for level, text in (self.geo or {}).items():
            text.select("value").coalesce(1).write.mode("overwrite").text(f"{path}/geo/{level}")
        spark.createDataFrame([(json.dumps(self.meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, levels: tuple[str, ...] = ()) -> Bundle:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(spark.read.parquet(f"{path}/units"), meta, {x: spark.read.text(f"{path}/geo/{x}") for x in levels})


EVENT = "event string, run_id string, run_name string, stage string, tags map<string,string>, metrics map<string,double>, steps map<string,int>, params map<string,string>, status string, experiment string, time_ms long"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines log, each with `seq`: its time, file and place in it."""
    return spark.read.schema(EVENT).json(path).withColumn("seq", F.struct(F.col("time_ms"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")))


def runs(events: DataFrame) -> DataFrame:
    """A row for each run: name, stage, status, and of each metric the value of the highest step (of equals the later line)."""
    base = events.groupBy("run_id").agg(F.max_by("run_name", F.when(F.col("run_name").isNotNull(), F.col("seq"))).alias("run_name"), F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("seq"))).alias("stage"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"))
    each = events.where("metrics is not null").select("run_id", "seq", "steps", F.explode("metrics").alias("name", "value"))
    each = each.withColumn("step", F.coalesce(F.try_element_at("steps", F.col("name")), F.lit(0)))
    last = each.groupBy("run_id", "name").agg(F.max_by("value", F.struct("step", "seq")).alias("value"))
    return base.join(last.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics")), "run_id", "left")


class RunLog:
    """Appends events of runs to a folder of JSON lines; names are made safe, infinite values are null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n = spark, path, 0

    def write(self, event: str, run_id: str, **fields) -> None:
        import math
        import re

        if "metrics" in fields:
            fields["metrics"] = {re.sub(r"[^\w./ -]", "_", k): (v if math.isfinite(v) else None) for k, v in fields["metrics"].items()}
        self.n += 1
        line = json.dumps({"event": event, "run_id": run_id, "time_ms": self.n, **fields})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(self.path)

    def frame(self) -> DataFrame:
        return runs(read_run_log(self.spark, self.path))


def latest_cached(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Content-addressed cache lines: the last of each key wins."""
    others = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(*(F.max_by(c, seq).alias(c) for c in others))


def cache_key(text, model: str, prompt: str):
    return F.sha2(F.concat_ws("\u0001", F.lit(model), F.lit(prompt), text), 256)


def request_batches(df: DataFrame, id_col: str, payload: str, most: int = 10_000, most_bytes: int = 200_000_000) -> DataFrame:
    """Adds batch: rows in the order of the id, a new batch after `most` rows or `most_bytes` bytes, within hash partitions."""
    from pyspark.sql.window import Window

    parts = df.withColumn("__p", F.pmod(F.xxhash64(id_col), F.lit(64)))
    w = Window.partitionBy("__p").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.octet_length(payload)).over(w)
    n = F.count("*").over(w)
    return parts.withColumn("batch", F.concat_ws("-", F.col("__p"), F.greatest(F.floor((n - 1) / most), F.floor((size - 1) / most_bytes)))).drop("__p")
