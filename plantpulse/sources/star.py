"""The star-schema test tables in the roles of telemetry tables.

Every function is a projection (at most one dimension join) of a whole table, so filters and
column pruning still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.schemas import ALERT_RULE, SEED_RULES

# Column types of the tables; stating them spares a look into the files before each query.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def code(prefix: str, key: str, width: int) -> str:
    """Expression: prefix and zero-padded number; longer numbers keep all their digits."""
    text = f"CAST({key} AS STRING)"
    return f"concat('{prefix}', lpad({text}, greatest({width}, length({text})), '0'))"


_K = "CAST(get_json_object(props, '$.k') AS DOUBLE)"


def events_as_readings(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "CAST(event_id AS STRING) AS data_id",
        "ts AS event_time",
        f"{code('R', 'user_id', 6)} AS robot_id",
        f"{code('S', 'event_id % 50', 3)} AS sensor_id",
        "CASE event_type WHEN 'view' THEN 'TEMPERATURE' WHEN 'click' THEN 'HUMIDITY' WHEN 'purchase' THEN 'PRESSURE' "
        "WHEN 'signup' THEN 'POSITION' ELSE 'VIBRATION' END AS sensor_type",
        "CASE WHEN event_type <> 'error' THEN value END AS temperature",
        f"{_K} AS humidity",
        "950D + value AS pressure",
        "CASE WHEN event_type = 'signup' THEN value END AS position_x",
        f"CASE WHEN event_type = 'signup' THEN {_K} END AS position_y",
        f"CASE WHEN event_type = 'signup' THEN value + {_K} END AS position_z",
        "CASE WHEN event_type = 'error' THEN 'ABNORMAL' ELSE 'NORMAL' END AS status",
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_readings(table(spark, folder, "events"))


def dim_robot(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    return table(spark, folder, "customer").join(nations, "c_nationkey").selectExpr(
        f"{code('R', 'c_custkey', 6)} AS robot_id", "c_name AS robot_name", "c_mktsegment AS robot_type",
        f"{code('M', 'c_nationkey', 3)} AS model", "n_name AS location", "c_mktsegment AS department",
        "TIMESTAMP_NTZ '2023-06-01 00:00:00' AS update_time",
        "CASE WHEN c_acctbal >= 1000 THEN 1 ELSE 0 END AS status")


def dim_sensor(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        f"{code('S', 'p_partkey', 3)} AS sensor_id", "p_name AS sensor_name",
        "CASE p_size % 6 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' WHEN 2 THEN 'PRESSURE' "
        "WHEN 3 THEN 'POSITION' WHEN 4 THEN 'VIBRATION' ELSE 'NOISE' END AS sensor_type",
        "p_brand AS manufacturer", "p_type AS model")


def robot_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        f"{code('R', 'c_custkey', 6)} AS robot_id", "c_name AS robot_name", "c_mktsegment AS robot_type",
        "CASE WHEN c_acctbal >= 1000 THEN 'ONLINE' ELSE 'OFFLINE' END AS status",
        "CASE c_nationkey % 4 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'STOPPED' ELSE 'PAUSED' END AS task_status",
        "c_nationkey * 4D AS battery_level", "round(c_acctbal / 80 + 1e-9D, 2) AS temperature",
        "CASE WHEN c_nationkey <> 24 THEN map('motor_temperature', c_acctbal / 75, 'line_pressure', c_acctbal / 8) END "
        "AS sensor_data")


def commands(spark: SparkSession, folder: str) -> DataFrame:
    started = "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 300)"
    return table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS command_id", f"{code('R', 'o_custkey', 6)} AS robot_id",
        "CASE o_orderkey % 5 WHEN 0 THEN 'START_TASK' WHEN 1 THEN 'STOP_TASK' WHEN 2 THEN 'PAUSE_TASK' "
        "WHEN 3 THEN 'RESUME_TASK' ELSE 'SELF_TEST' END AS command_type",
        "CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority",
        "CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'EXECUTED' ELSE 'FAILED' END AS status",
        "o_orderdate AS create_time",
        f"CASE WHEN o_orderstatus IN ('F', 'P') THEN {started} END AS execute_time",
        f"CASE WHEN o_orderstatus = 'F' THEN {started} + make_dt_interval(0, 0, 0, o_orderkey % 97) END AS complete_time",
        "CAST(o_orderkey % 5 AS INT) AS retry_count", "3 AS max_retry")


def command_events(spark: SparkSession, folder: str) -> DataFrame:
    """Command log: one PENDING row per order, one further row per line item."""
    opened = table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS command_id", "0 AS event_seq", "'PENDING' AS status", "o_orderdate AS event_time")
    later = table(spark, folder, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS command_id", "l_linenumber AS event_seq",
        "CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' THEN 'EXECUTED' "
        "WHEN l_linestatus = 'O' THEN 'RETRYING' ELSE 'CANCELLED' END AS status",
        "l_shipdate AS event_time")
    return opened.unionByName(later)


def status_history(spark: SparkSession, folder: str) -> DataFrame:
    """State reports of robots over time with their battery level: one per event."""
    return table(spark, folder, "events").selectExpr(
        "CAST(event_id AS STRING) AS data_id", "ts AS event_time", f"{code('R', 'user_id', 6)} AS robot_id",
        f"{_K} AS battery_level")


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Each owner follows its own robot (some one type only); each region follows one type everywhere, one nation all."""
    own = table(spark, folder, "customer").selectExpr(
        "concat('SUB-C', CAST(c_custkey AS STRING)) AS subscription_id",
        f"array({code('R', 'c_custkey', 6)}) AS robot_ids",
        "CASE WHEN c_nationkey % 2 = 0 THEN array('TEMPERATURE', 'PRESSURE') END AS sensor_types")
    wide = table(spark, folder, "region").selectExpr(
        "concat('SUB-G', CAST(r_regionkey AS STRING)) AS subscription_id",
        "CAST(NULL AS ARRAY<STRING>) AS robot_ids",
        "array(CASE r_regionkey WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' WHEN 2 THEN 'PRESSURE' "
        "WHEN 3 THEN 'POSITION' ELSE 'VIBRATION' END) AS sensor_types")
    none = "CAST(NULL AS ARRAY<STRING>)"
    every = table(spark, folder, "nation").filter("n_nationkey = 0").selectExpr(
        "concat('SUB-N', CAST(n_nationkey AS STRING)) AS subscription_id", f"{none} AS robot_ids", f"{none} AS sensor_types")
    return own.unionByName(wide).unionByName(every)


def robot_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension updates: one per order."""
    return table(spark, folder, "orders").selectExpr(
        f"{code('R', 'o_custkey', 6)} AS robot_id", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS status",
        "concat('DOCK-', substr(o_orderpriority, 1, 1)) AS location", "o_orderdate AS update_time")


def listed_robots(spark: SparkSession, folder: str) -> DataFrame:
    """Robot ids to look up: one per supplier."""
    return table(spark, folder, "supplier").selectExpr(f"{code('R', 's_suppkey', 6)} AS robot_id")


def alert_rules(spark: SparkSession, extra=()) -> DataFrame:
    return spark.createDataFrame(list(SEED_RULES) + list(extra), ALERT_RULE)


def part_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule per part: price sets the threshold, size the operator and the days that the condition must last."""
    return table(spark, folder, "part").selectExpr(
        "concat('PART', CAST(p_partkey AS STRING)) AS rule_id", "p_name AS rule_name",
        "CASE p_partkey % 3 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' ELSE 'PRESSURE' END AS rule_type",
        "'' AS description",
        "to_json(named_struct('metric', CASE p_partkey % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'humidity' ELSE 'pressure' END, "
        "'operator', CASE p_size % 4 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<' ELSE '<=' END, "
        "'threshold', p_retailprice + CASE p_partkey % 3 WHEN 2 THEN 50D ELSE -900D END, "
        "'duration', (7 + p_size % 7) * 86400L)) AS conditions",
        "'{}' AS actions", "CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS severity",
        "CASE WHEN p_size = 13 THEN 0 ELSE 1 END AS enable_flag")


def operation_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS log_id", "concat('user', CAST(o_custkey AS STRING)) AS user_id",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'query' ELSE 'export' END AS operation",
        "CAST(o_orderkey % 1000 AS INT) AS request_time", "o_orderdate AS create_time")


def backup_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS task_id",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'FULL_BACKUP' ELSE 'INCREMENTAL_BACKUP' END AS task_type",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status",
        "o_orderdate AS start_time",
        "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 3600) END AS end_time",
        "CAST(floor(o_totalprice) AS BIGINT) AS backup_size", "o_orderkey % 100 + 1 AS file_count")


def compression_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS task_id",
        "CASE WHEN l_linestatus = 'O' THEN 'COMPLETED' ELSE 'FAILED' END AS status",
        "CAST(l_quantity AS BIGINT) AS compressed_files",
        "CAST(floor(l_extendedprice) AS BIGINT) AS original_size",
        "CAST(floor(l_extendedprice * (1D - l_discount)) AS BIGINT) AS compressed_size",
        "l_returnflag AS compression_algorithm")


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Job runs: one per line item; quantity is the record count, a returned line is a failed run."""
    return table(spark, folder, "lineitem").selectExpr(
        "CASE WHEN l_linestatus = 'O' THEN 'DAILY' ELSE 'WEEKLY' END AS job_type",
        "CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCESS' END AS status",
        "CAST(l_quantity AS BIGINT) AS records", "CAST(l_quantity AS BIGINT) % 5 AS failed_records",
        "l_extendedprice AS duration_ms")
