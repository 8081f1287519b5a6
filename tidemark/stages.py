"""Written intermediate tables, which cut lineage: a lost executor costs a reread, and what several steps use is computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir


class Stage:
    """Written tables in the folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for x in tables:
            path = jvm.org.apache.hadoop.fs.Path(x.staged_at)
            path.getFileSystem(conf).delete(path, True)
