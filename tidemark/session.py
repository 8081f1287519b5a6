"""The SparkSession that tests and benchmarks use, and the folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """The data root and its zones."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def curated(self) -> str:
        return f"{self.root}/curated"

    @property
    def reports(self) -> str:
        return f"{self.root}/reports"


def settings() -> Settings:
    """Settings by the variable TIDEMARK_DATA, else a folder in the user's home; the root may be any path that Spark reads."""
    return Settings((os.environ.get("TIDEMARK_DATA") or str(Path.home() / "tidemark-data")).rstrip("/"))


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with UTC timestamps, adaptive execution and few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    defaults = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Where it is unset: a temporary folder of a local session, else the warehouse."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if spark.sparkContext.master.startswith("local"):
        return f"{tempfile.gettempdir()}/checkpoints"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
