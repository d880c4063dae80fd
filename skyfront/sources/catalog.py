"""Named datasets in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .text_sets import read_datasets


class Catalog:
    """Datasets by name: Parquet tables and text sets of one folder. Nothing is downloaded."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        """Where the dataset of this file name is; raises if the folder has none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(f"{self.folder}/{name}")
        return f"{self.folder}/{name}"

    def load(self, name: str) -> DataFrame:
        path = self.path(name)
        return self.spark.read.parquet(path) if name.endswith(".parquet") else read_datasets(self.spark, path)
