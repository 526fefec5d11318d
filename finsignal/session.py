"""Spark session with the settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every job assumes; cluster sizes, memory and folders come from the deployment.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "finsignal", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session. `conf` overrides DEFAULTS; underscores in names stand for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    named = {"spark_sql_shuffle_partitions": "spark.sql.shuffle.partitions", "spark_sql_warehouse_dir": "spark.sql.warehouse.dir", "spark_ui_showConsoleProgress": "spark.ui.showConsoleProgress"}
    for key, value in (DEFAULTS | {named.get(k, k.replace("_", ".")): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given Parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
