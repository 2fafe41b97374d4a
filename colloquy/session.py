"""Session settings shared by the library, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings whose values change results, not only speed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

#: Settings for physical execution; a cluster's own values win over these.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", name: str = "colloquy", memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **SEMANTIC_CONF,
        **RUNTIME_CONF,
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """df over at least as many partitions as there are cores, where it is read in fewer, as a small file of one row group is; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
