"""Topic sinks: rows with topic, key and value columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_kafka(rows: DataFrame, servers: str) -> None:
    """Batch write; the `topic` column routes each row. Needs the spark-sql-kafka package."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def stream_to_kafka(rows: DataFrame, servers: str, checkpoint: str):
    return (rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint).start())


def to_files(rows: DataFrame, path: str) -> None:
    """The same rows as JSON lines, one folder per topic with slashes replaced."""
    from pyspark.sql import functions as F

    (rows.withColumn("topic", F.translate("topic", "/", "_"))
     .write.mode("append").partitionBy("topic").json(path))
