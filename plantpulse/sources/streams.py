"""Streaming sources: Kafka topics, or files with the same message layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.schemas import DEFAULT_TOPICS, TOPIC_PATTERN


def kafka_options(servers: str, topics=DEFAULT_TOPICS, pattern: str | None = None, per_trigger: int = 500_000) -> dict:
    """Reader options: earliest offsets, committed records only, a bounded micro-batch."""
    options = {
        "kafka.bootstrap.servers": servers,
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
        "maxOffsetsPerTrigger": str(per_trigger),
        "failOnDataLoss": "true",
    }
    if pattern:
        options["subscribePattern"] = pattern
    else:
        options["subscribe"] = ",".join(topics)
    return options


def kafka_stream(spark: SparkSession, servers: str, topics=DEFAULT_TOPICS, pattern: str | None = None,
                 per_trigger: int = 500_000) -> DataFrame:
    """Raw topic rows. Needs the spark-sql-kafka package on the class path."""
    options = kafka_options(servers, topics, pattern, per_trigger)
    return spark.readStream.format("kafka").options(**options).load()


def all_sensor_topics(spark: SparkSession, servers: str, **kw) -> DataFrame:
    return kafka_stream(spark, servers, pattern=TOPIC_PATTERN, **kw)


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """One JSON message per line, column `value`."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
