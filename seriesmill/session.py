"""Session settings that the operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Ranks up to this limit are cut before the shuffle: above the default cap of series.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def configure(spark: SparkSession) -> SparkSession:
    """Sets the runtime settings on a session that exists already."""
    importable(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "seriesmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    importable(spark)
    return spark
