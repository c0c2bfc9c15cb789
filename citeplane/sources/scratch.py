"""Tables written to the folder that all executors share, to cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_citeplane_folder", None)
        if not base:
            base = spark._citeplane_folder = tempfile.mkdtemp(prefix="citeplane-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/citeplane/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
