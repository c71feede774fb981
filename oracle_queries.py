"""DuckDB SQL for every registered query that SQL can express.

The test tables are put into the telemetry roles by common table expressions, since only the tables
themselves are registered as views.
"""

from __future__ import annotations


def _code(prefix: str, key: str, width: int) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"'{prefix}' || lpad({text}, CAST(greatest({width}, length({text})) AS INTEGER), '0')"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr} + 1e-9, {digits}) AS {name}"


READINGS = f"""readings AS (
  SELECT CAST(event_id AS VARCHAR) AS data_id, ts AS event_time,
    {_code('R', 'user_id', 6)} AS robot_id, {_code('S', '(event_id % 50)', 3)} AS sensor_id,
    CASE event_type WHEN 'view' THEN 'TEMPERATURE' WHEN 'click' THEN 'HUMIDITY' WHEN 'purchase' THEN 'PRESSURE'
      WHEN 'signup' THEN 'POSITION' ELSE 'VIBRATION' END AS sensor_type,
    CASE WHEN event_type <> 'error' THEN value END AS temperature,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity,
    CAST(950 AS DOUBLE) + value AS pressure,
    CASE WHEN event_type = 'signup' THEN value END AS position_x,
    CASE WHEN event_type = 'signup' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS position_y,
    CASE WHEN event_type = 'signup' THEN value + CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS position_z,
    CASE WHEN event_type = 'error' THEN 'ABNORMAL' ELSE 'NORMAL' END AS status
  FROM events)"""

DIM_ROBOT = f"""dim_robot AS (
  SELECT {_code('R', 'c_custkey', 6)} AS robot_id, c_name AS robot_name, c_mktsegment AS robot_type,
    n_name AS location, TIMESTAMP '2023-06-01 00:00:00' AS update_time,
    CASE WHEN c_acctbal >= 1000 THEN 1 ELSE 0 END AS status
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

DIM_SENSOR = f"""dim_sensor AS (
  SELECT {_code('S', 'p_partkey', 3)} AS sensor_id, p_name AS sensor_name,
    CASE p_size % 6 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY' WHEN 2 THEN 'PRESSURE' WHEN 3 THEN 'POSITION'
      WHEN 4 THEN 'VIBRATION' ELSE 'NOISE' END AS sensor_type
  FROM part)"""

STATUS = f"""robot_status AS (
  SELECT {_code('R', 'c_custkey', 6)} AS robot_id, c_name AS robot_name, c_mktsegment AS robot_type,
    CASE WHEN c_acctbal >= 1000 THEN 'ONLINE' ELSE 'OFFLINE' END AS status,
    CASE c_nationkey % 4 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'STOPPED' ELSE 'PAUSED' END AS task_status,
    c_nationkey * CAST(4 AS DOUBLE) AS battery_level, round(c_acctbal / 80 + 1e-9, 2) AS temperature,
    c_nationkey <> 24 AS has_map, c_acctbal / 75 AS motor_temperature, c_acctbal / 8 AS line_pressure
  FROM customer)"""

COMMANDS = f"""commands AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS command_id, {_code('R', 'o_custkey', 6)} AS robot_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'START_TASK' WHEN 1 THEN 'STOP_TASK' WHEN 2 THEN 'PAUSE_TASK'
      WHEN 3 THEN 'RESUME_TASK' ELSE 'SELF_TEST' END AS command_type,
    CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'EXECUTED' ELSE 'FAILED' END AS status,
    o_orderdate AS create_time,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate + to_seconds(o_orderkey % 300) END AS execute_time,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 300) + to_seconds(o_orderkey % 97) END AS complete_time,
    CAST(o_orderkey % 5 AS INTEGER) AS retry_count, 3 AS max_retry
  FROM orders)"""

COMMAND_EVENTS = """command_events AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS command_id, 0 AS event_seq, 'PENDING' AS status, o_orderdate AS event_time FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' THEN 'EXECUTED'
      WHEN l_linestatus = 'O' THEN 'RETRYING' ELSE 'CANCELLED' END, l_shipdate
  FROM lineitem)"""

BACKUP_TASKS = """backup_tasks AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS task_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'FULL_BACKUP' ELSE 'INCREMENTAL_BACKUP' END AS task_type,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status,
    o_orderdate AS start_time,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(o_orderkey % 3600) END AS end_time,
    CAST(floor(o_totalprice) AS BIGINT) AS backup_size, o_orderkey % 100 + 1 AS file_count
  FROM orders)"""

_STATS = {"temperature": ("avg", "max", "min"), "humidity": ("avg", "max", "min"), "pressure": ("avg",)}


def _measures(metrics=("temperature", "humidity", "pressure"), full: bool = False) -> str:
    out = []
    for m in metrics:
        for fn in (("avg", "max", "min") if full else _STATS[m]):
            out.append(_r(f"{fn}({m})", f"{fn}_{m}"))
    return ", ".join(out)


BOUND = "event_time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ROUTED = f"""routed AS (
  SELECT robot_id, avg(temperature) AS avg_temperature, max(temperature) AS max_temperature, min(temperature) AS min_temperature,
    avg(humidity) AS avg_humidity, max(humidity) AS max_humidity, min(humidity) AS min_humidity,
    avg(pressure) AS avg_pressure, count(*) AS data_count
  FROM readings WHERE {BOUND} GROUP BY robot_id)"""

DAILY = """routed AS (
  SELECT robot_id, avg(temperature) AS avg_temperature FROM readings GROUP BY CAST(event_time AS DATE), robot_id)"""


def _realtime(where: str) -> str:
    return _with(READINGS, DIM_ROBOT) + f"""
SELECT r.robot_id, r.robot_name, r.robot_type, {_measures()}, count(*) AS data_count
FROM readings s JOIN dim_robot r ON s.robot_id = r.robot_id WHERE {where}
GROUP BY r.robot_id, r.robot_name, r.robot_type"""


_LISTED = "sensor_type IN ('TEMPERATURE', 'HUMIDITY')"


def _incremental(where: str, metrics=("temperature", "humidity", "pressure")) -> str:
    return _with(READINGS) + f"""
SELECT robot_id, {_measures(metrics)}, count(*) AS data_count FROM readings WHERE {where} GROUP BY robot_id"""


def _bucket(label: str) -> str:
    return _with(READINGS) + f"""
SELECT {label} AS time_bucket, robot_id, count(*) AS data_count, {_measures(full=True)}
FROM readings WHERE {BOUND} GROUP BY 1, 2"""


def _trend(label: str, unit: str) -> str:
    inner = ", ".join(f"coalesce(avg({m}), 0) AS {m}" for m in _STATS)
    outer = ", ".join(_r(f"avg({m})", m) for m in _STATS)
    return _with(READINGS, f"""cells AS (
  SELECT {label} AS time_label, robot_id, {inner}, count(*) AS n FROM readings
  WHERE event_time BETWEEN TIMESTAMP '2024-01-01' - INTERVAL 10 {unit} AND TIMESTAMP '2024-01-31' + INTERVAL 1 {unit} GROUP BY 1, 2)""") + f"""
SELECT time_label, {outer}, CAST(sum(n) AS BIGINT) AS data_count FROM cells GROUP BY time_label"""


_STATISTICS = ", ".join(
    ", ".join([_r(f"coalesce(avg(avg_{m}), 0)", f"{m}_avg"), _r(f"coalesce(max(avg_{m}), 0)", f"{m}_max"),
               _r(f"coalesce(min(avg_{m}), 0)", f"{m}_min"), f"count(avg_{m}) AS {m}_count"])
    for m in _STATS)


def _distribution(metric: str, bins: int, include_max: bool) -> str:
    last = f" OR (b.i = {bins - 1} AND v = high AND high > low)" if include_max else ""
    return _with(READINGS, ROUTED, f"vals AS (SELECT avg_{metric} AS v FROM routed WHERE avg_{metric} IS NOT NULL)", f"""
s AS (SELECT min(v) AS low, max(v) AS high, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS deviation FROM vals)""", f"""
b AS (SELECT range AS i, low + range * ((high - low) / {bins}) AS lo, low + (range + 1) * ((high - low) / {bins}) AS hi,
    s.* FROM range({bins}), s)""") + f"""
SELECT b.i AS bin, {_r('lo', 'bucket_min')}, {_r('hi', 'bucket_max')}, count(v) AS bucket_count,
  {_r('count(v) / any_value(n) * 100', 'percentage')}, {_r('any_value(low)', 'min_value')},
  {_r('any_value(high)', 'max_value')}, {_r('any_value(mean)', 'mean_value')}, {_r('any_value(deviation)', 'std_dev')}
FROM b LEFT JOIN vals ON (v >= lo AND v < hi){last}
GROUP BY b.i, lo, hi"""


_STATISTICAL = f"""SELECT robot_id, 'STATISTICAL' AS anomaly_type, 'temperature' AS metric, {_r('avg_temperature', 'value')},
  {_r('mean - 3 * sigma', 'expected_min')}, {_r('mean + 3 * sigma', 'expected_max')}, 'HIGH' AS severity
FROM routed, (SELECT avg(avg_temperature) AS mean, stddev_pop(avg_temperature) AS sigma FROM routed)
WHERE abs(avg_temperature - mean) > 3 * sigma"""

_THRESHOLD = f"""SELECT robot_id, 'THRESHOLD' AS anomaly_type, 'temperature' AS metric, {_r('avg_temperature', 'value')},
  {_r('CAST(0 AS DOUBLE)', 'expected_min')}, {_r('CAST(100 AS DOUBLE)', 'expected_max')},
  CASE WHEN avg_temperature > 80 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity
FROM routed WHERE avg_temperature < 0 OR avg_temperature > 100"""

_ABNORMAL = """has_map AND (temperature > 80 OR battery_level < 10 OR motor_temperature > 100
      OR line_pressure < 0 OR line_pressure > 1000)"""

JUDGED_ROBOTS = f"""judged AS (
  SELECT *, {_ABNORMAL} AS abnormal,
    CASE WHEN temperature > 80 THEN 'Temperature too high: ' || CAST(temperature AS VARCHAR) || '°C; ' ELSE '' END
    || CASE WHEN battery_level < 10 THEN 'Battery too low: ' || CAST(battery_level AS VARCHAR) || '%; ' ELSE '' END AS description
  FROM robot_status), graded AS (
  SELECT *, CASE WHEN NOT abnormal THEN 'NORMAL' WHEN temperature > 100 THEN 'CRITICAL'
    WHEN battery_level < 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM judged)"""


_RULES = """rules AS (
  SELECT * FROM (VALUES
    ('RULE001', 'TEMPERATURE', 'HIGH', 'temperature', '>', 80, 300),
    ('RULE003', 'HUMIDITY', 'LOW', 'humidity', '<', 20, 600),
    ('RULE004', 'PRESSURE', 'MEDIUM', 'pressure', '>=', 1000, 3600))
  AS t(rule_id, alert_type, severity, metric, op, threshold, duration))"""

_PART_RULES = """rules AS (
  SELECT 'PART' || CAST(p_partkey AS VARCHAR) AS rule_id, upper(metric) AS alert_type,
    CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS severity, metric,
    CASE p_size % 4 WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<' ELSE '<=' END AS op,
    p_retailprice + CASE p_partkey % 3 WHEN 2 THEN 50::DOUBLE ELSE -900::DOUBLE END AS threshold,
    (7 + p_size % 7) * 86400 AS duration
  FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'humidity' ELSE 'pressure' END AS metric FROM part)
  WHERE p_size <> 13)"""


def _alerts(keys: str, rules: str = _RULES) -> str:
    return _with(READINGS, rules, f"""vals AS (
  SELECT {keys}, event_time, data_id, 'temperature' AS metric, temperature AS v FROM readings
  UNION ALL SELECT {keys}, event_time, data_id, 'humidity', humidity FROM readings
  UNION ALL SELECT {keys}, event_time, data_id, 'pressure', pressure FROM readings)""", f"""marked AS (
  SELECT rule_id, alert_type, severity, duration, {keys}, event_time, data_id,
    CASE op WHEN '>' THEN v > threshold WHEN '<' THEN v < threshold WHEN '<=' THEN v <= threshold ELSE v >= threshold END AS breach
  FROM vals JOIN rules USING (metric) WHERE v IS NOT NULL)""", f"""numbered AS (
  SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (
    PARTITION BY rule_id, {keys} ORDER BY event_time, data_id ROWS UNBOUNDED PRECEDING) AS gap FROM marked)""", f"""
alerts AS (
  SELECT rule_id, alert_type, severity, {keys}, min(event_time) AS start_time, max(event_time) AS end_time,
    count(*) AS readings, date_sub('second', min(event_time), max(event_time)) AS lasted_seconds
  FROM numbered WHERE breach GROUP BY rule_id, alert_type, severity, duration, {keys}, gap
  HAVING date_sub('second', min(event_time), max(event_time)) >= duration)""")


LATEST = """latest AS (
  SELECT r.* FROM readings r JOIN (SELECT robot_id, max(event_time) AS event_time FROM readings GROUP BY robot_id)
  USING (robot_id, event_time))"""

_ORDERED = """ordered AS (
  SELECT *, row_number() OVER (ORDER BY event_time, data_id) - 1 AS i, count(*) OVER () AS total FROM readings)"""


def _freshness(source: str) -> str:
    return f"""
SELECT robot_id, last_update_time, reported_status,
  CASE WHEN last_update_time + INTERVAL 6 HOUR >= TIMESTAMP '2024-01-31 00:00:00' THEN reported_status ELSE 'OFFLINE' END AS status
FROM ({source})"""


_LAST_BEAT = """SELECT robot_id, event_time AS last_update_time, status AS reported_status FROM (
  SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY event_time DESC, data_id DESC) AS rn FROM readings) WHERE rn = 1"""

_REASON = """CASE WHEN temperature IS NOT NULL AND NOT temperature BETWEEN -50 AND 150 THEN 'temperature out of range'
    WHEN humidity IS NOT NULL AND NOT humidity BETWEEN 0 AND 100 THEN 'humidity out of range'
    WHEN pressure IS NOT NULL AND NOT pressure BETWEEN 500 AND 1500 THEN 'pressure out of range' END"""

SUBSCRIPTIONS = f"""subs AS (
  SELECT 'SUB-C' || CAST(c_custkey AS VARCHAR) AS subscription_id, {_code('R', 'c_custkey', 6)} AS robot_id,
    CASE WHEN c_nationkey % 2 = 0 THEN ['TEMPERATURE', 'PRESSURE'] END AS types FROM customer
  UNION ALL
  SELECT 'SUB-G' || CAST(r_regionkey AS VARCHAR), NULL, [CASE r_regionkey WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'HUMIDITY'
    WHEN 2 THEN 'PRESSURE' WHEN 3 THEN 'POSITION' ELSE 'VIBRATION' END] FROM region
  UNION ALL SELECT 'SUB-N' || CAST(n_nationkey AS VARCHAR), NULL, NULL FROM nation WHERE n_nationkey = 0)"""


def _performance(hours: int) -> str:
    return _with(READINGS) + f"""
SELECT 'readings' AS table_name, count(*) AS total_records, min(event_time) AS earliest_time, max(event_time) AS latest_time,
  count(DISTINCT robot_id) AS unique_robots, count(DISTINCT sensor_id) AS unique_sensors,
  round(avg(temperature), 2) AS avg_temperature, round(avg(humidity), 2) AS avg_humidity, round(avg(pressure), 2) AS avg_pressure
FROM readings WHERE event_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {hours} HOUR"""


def _generic(metric: str, interval: str, label: str) -> str:
    return f"""SELECT {label} AS time_bucket, sensor_type, {_r(f'avg({metric})', 'avg_value', 5)}, {_r(f'max({metric})', 'max_value', 5)},
  {_r(f'min({metric})', 'min_value', 5)}, round(round(sum({metric}), 2) + 1e-9, 5) AS sum_value, count({metric}) AS count_value,
  {_r(f'stddev_pop({metric})', 'stddev_value', 5)}, '{interval}' AS "interval" FROM readings GROUP BY 1, 2"""



ORACLE: dict[str, str] = {
    "route_realtime": _realtime(BOUND),
    "route_realtime_window": _realtime("s.event_time BETWEEN '2024-01-10 12:00:00' AND '2024-01-10 12:05:00'"),
    "route_incremental": _incremental(BOUND),
    "route_incremental_day": _incremental("event_time BETWEEN '2024-01-15 00:00:00' AND '2024-01-16 00:00:00'"),
    "route_historical_rollup": _incremental("CAST(event_time AS DATE) BETWEEN '2024-01-01' AND '2024-01-31'", ("temperature", "humidity")),
    "route_stored_rollup": _incremental("CAST(event_time AS DATE) BETWEEN '2024-01-01' AND '2024-01-31'", ("temperature", "humidity")),
    "route_historical_fallback": _incremental(BOUND, ("temperature", "pressure")),
    "route_listed_short": _incremental(f"{BOUND} AND {_LISTED} AND CAST(substr(robot_id, 2) AS BIGINT) % 3 = 0 "
                                       "AND CAST(substr(robot_id, 2) AS BIGINT) < 1200"),
    "route_listed_long": _incremental(f"{BOUND} AND {_LISTED} AND CAST(substr(robot_id, 2) AS BIGINT) % 2 = 0 "
                                      "AND CAST(substr(robot_id, 2) AS BIGINT) < 6000"),
    "route_ingested": _incremental(f"{BOUND} AND ({_REASON}) IS NULL"),
    "hourly_rollup": _with(READINGS) + "SELECT strftime(event_time, '%Y-%m-%d') AS dt, strftime(event_time, '%H') AS hr, robot_id, sensor_type, "
    + ", ".join(f"{_r(f'sum({m})', f'sum_{m}')}, count({m}) AS cnt_{m}, {_r(f'avg({m})', f'avg_{m}')}, "
                f"{_r(f'max({m})', f'max_{m}')}, {_r(f'min({m})', f'min_{m}')}" for m in _STATS)
    + """, count(*) AS data_count, count(*) FILTER (WHERE status <> 'NORMAL') AS abnormal_count
FROM readings GROUP BY 1, 2, 3, 4""",
    "bucket_minute": _bucket("strftime(event_time, '%Y-%m-%d %H:%M:00')"),
    "bucket_hourly": _bucket("strftime(event_time, '%Y-%m-%d %H:00:00')"),
    "bucket_daily": _bucket("strftime(event_time, '%Y-%m-%d')"),
    "bucket_weekly": _bucket("strftime(event_time, '%G-%V')"),
    "trend_minute": _trend("strftime(event_time, '%Y-%m-%d %H:%M')", "MINUTE"),
    "trend_hour": _trend("strftime(event_time, '%Y-%m-%d %H:00')", "HOUR"),
    "trend_day": _trend("strftime(event_time, '%Y-%m-%d')", "DAY"),
    "generic_aggregate": _with(READINGS) + "\nUNION ALL\n".join([
        _generic("temperature", "hour", "strftime(event_time, '%Y-%m-%d %H:00')"),
        _generic("humidity", "day", "strftime(event_time, '%Y-%m-%d')"),
        _generic("temperature", "week", "strftime(event_time, '%G-%V')"),
        _generic("pressure", "month", "strftime(event_time, '%Y-%m')")]),
    "statistics": _with(READINGS, ROUTED) + f"SELECT count(*) AS total_records, {_STATISTICS} FROM routed",
    "overview": _with(READINGS, ROUTED, f"figures AS (SELECT count(*) AS robots, sum(data_count) AS records, {_STATISTICS} FROM routed)", f"""cells AS (
  SELECT strftime(event_time, '%Y-%m-%d %H:00') AS label, robot_id, coalesce(avg(temperature), 0) AS temperature,
    coalesce(avg(humidity), 0) AS humidity, coalesce(avg(pressure), 0) AS pressure, count(*) AS n FROM readings WHERE {BOUND} GROUP BY 1, 2)""", """
hours AS (SELECT label, avg(temperature) AS temperature, avg(humidity) AS humidity, avg(pressure) AS pressure, sum(n) AS n
  FROM cells GROUP BY label)""") + "\nUNION ALL\n".join(
        [f"SELECT 'summary' AS section, 'all' AS label, '{n}' AS name, {_r(f'CAST({n} AS DOUBLE)', 'value')} FROM figures"
         for n in ["robots", "records"] + [f"{m}_{s}" for m in _STATS for s in ("avg", "max", "min", "count")]]
        + [f"SELECT 'trend', label, '{name}', {_r(f'CAST({c} AS DOUBLE)', 'value')} FROM hours"
           for name, c in (("temperature", "temperature"), ("humidity", "humidity"), ("pressure", "pressure"), ("data_count", "n"))]),
    "quality_report": _with(READINGS, ROUTED, """q AS (
  SELECT count(*) AS total_records,
    count(*) FILTER (WHERE avg_temperature IS NOT NULL AND avg_humidity IS NOT NULL AND avg_pressure IS NOT NULL) AS complete_records,
    count(*) AS valid_records, count(*) FILTER (WHERE avg_temperature > 100 OR avg_temperature < -50) AS abnormal_records FROM routed)""") + f"""
SELECT *, {_r('complete_records / total_records', 'completeness_rate')}, {_r('valid_records / total_records', 'validity_rate')},
  {_r('abnormal_records / total_records', 'abnormality_rate')},
  {_r('(complete_records / total_records + valid_records / total_records) / 2 * 100', 'overall_quality')} FROM q""",
    "distribution": _distribution("temperature", 10, False),
    "distribution_with_max": _distribution("humidity", 7, True),
    "chart_series": _with(READINGS, ROUTED) + f"""SELECT robot_id AS label, {_r('coalesce(avg_temperature, 0)', 'temperature')},
  {_r('coalesce(avg_humidity, 0)', 'humidity')}, {_r('coalesce(avg_pressure, 0)', 'pressure')} FROM routed""",
    "report_detailed": _with(READINGS, ROUTED) + f"""
SELECT robot_id, {_r('avg_temperature', 'avg_temperature')}, {_r('avg_humidity', 'avg_humidity')}, {_r('avg_pressure', 'avg_pressure')} FROM routed
UNION ALL SELECT 'ALL', {_r('avg(avg_temperature)', 'a')}, {_r('avg(avg_humidity)', 'b')}, {_r('avg(avg_pressure)', 'c')} FROM routed""",
    "daily_summary": _with(READINGS) + f"""SELECT strftime(event_time, '%Y-%m-%d') AS dt, robot_id, {_measures(full=True)}, count(*) AS data_count
FROM readings GROUP BY 1, 2""",
    "weekly_report": _with(READINGS) + """
SELECT strftime(monday, '%G-%V') AS week, count(*) AS total_records, CAST(sum(n) AS BIGINT) AS data_count,
  strftime(monday, '%Y-%m-%d') || ' - ' || strftime(monday + INTERVAL 6 DAY, '%Y-%m-%d') AS period
FROM (SELECT CAST(date_trunc('week', event_time) AS TIMESTAMP) AS monday, robot_id, count(*) AS n FROM readings GROUP BY 1, 2)
GROUP BY monday""",
    "export_csv_rows": _realtime(BOUND),
    "export_json_header": _with(READINGS, ROUTED) + "SELECT '2024-01-31 00:00:00' AS export_time, count(*) AS total_records FROM routed",
    "desensitize": _with(READINGS) + f"""SELECT data_id, '***' AS robot_id, CAST(floor(temperature + 0.5) AS BIGINT) AS temperature,
  {_r('pressure', 'pressure')}, status FROM readings""",
    "desensitize_noise": _with(READINGS) + f"""SELECT data_id,
  {_r("pressure * (1.0 + (CAST(CAST('0x' || substr(md5('7|' || data_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE)", 'pressure')}
FROM readings""",
    "anomaly_statistical": _with(READINGS, ROUTED) + _STATISTICAL,
    "anomaly_threshold": _with(READINGS, DAILY) + _THRESHOLD,
    "anomaly_all": _with(READINGS, DAILY) + _STATISTICAL + "\nUNION ALL\n" + _THRESHOLD,
    "robot_abnormal": _with(STATUS, JUDGED_ROBOTS) + "SELECT robot_id, abnormal, severity, description FROM graded",
    "robot_alerts": _with(STATUS, JUDGED_ROBOTS) + """SELECT robot_id, robot_name, 'ROBOT_ABNORMAL' AS alert_type, severity,
  description, status, task_status FROM graded WHERE abnormal""",
    "alert_rules_sustained": _alerts("robot_id, sensor_id") + "SELECT * FROM alerts",
    "alert_rules_by_robot": _alerts("robot_id") + "SELECT * FROM alerts",
    "alert_rules_chunked": _alerts("robot_id") + "SELECT * FROM alerts",
    "alert_rules_indexed": _alerts("robot_id", _PART_RULES) + "SELECT * FROM alerts",
    "alert_rules_indexed_chunked": _alerts("robot_id", _PART_RULES) + "SELECT * FROM alerts",
    "alert_rules_battery": _with(READINGS, """numbered AS (
  SELECT *, humidity < 10 AS breach, sum(CASE WHEN humidity < 10 THEN 0 ELSE 1 END) OVER (
    PARTITION BY robot_id ORDER BY event_time, data_id ROWS UNBOUNDED PRECEDING) AS gap FROM readings WHERE humidity IS NOT NULL)""") + """
SELECT 'RULE002' AS rule_id, 'BATTERY' AS alert_type, 'CRITICAL' AS severity, robot_id, min(event_time) AS start_time,
  max(event_time) AS end_time, count(*) AS readings, date_sub('second', min(event_time), max(event_time)) AS lasted_seconds
FROM numbered WHERE breach GROUP BY robot_id, gap HAVING date_sub('second', min(event_time), max(event_time)) >= 60""",
    "alert_records": _alerts("robot_id") + """SELECT rule_id, robot_id, rule_id || ' on ' || robot_id AS title,
  'held for ' || CAST(lasted_seconds AS VARCHAR) || ' s' AS content, severity, 'ACTIVE' AS status, end_time AS create_time FROM alerts""",
    "realtime_topn": _with(READINGS) + """SELECT data_id, event_time, robot_id, sensor_type FROM readings
ORDER BY event_time DESC, data_id DESC LIMIT 50""",
    "range_query": _with(READINGS) + f"SELECT data_id, event_time, robot_id, {_r('temperature', 'temperature')}, {_r('position_z', 'position_z')} FROM readings WHERE {BOUND}",
    "page_query": _with(READINGS) + """SELECT data_id, event_time, robot_id, count(*) OVER () AS total,
  CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS pages FROM readings ORDER BY event_time, data_id LIMIT 20 OFFSET 40""",
    "page_deep": _with(READINGS) + """SELECT data_id, event_time, robot_id, count(*) OVER () AS total,
  CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS pages FROM readings ORDER BY event_time, data_id LIMIT 20 OFFSET 580""",
    "page_with_nulls": _with(READINGS) + """SELECT temperature, data_id, count(*) OVER () AS total,
  CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS pages FROM readings ORDER BY temperature NULLS FIRST, data_id LIMIT 20 OFFSET 580""",
    "sample_random": _with(READINGS) + "SELECT data_id, robot_id FROM readings ORDER BY md5('3|' || data_id), data_id LIMIT 100",
    "latest_reading": _with(READINGS, LATEST) + "SELECT robot_id, data_id, event_time, sensor_id FROM latest",
    "robot_sensor_latest": _with(READINGS, LATEST, STATUS, DIM_ROBOT, DIM_SENSOR) + f"""
SELECT s.robot_id, s.robot_name, s.robot_type, s.status, d.location, {_r('s.battery_level', 'battery_level')},
  {_r('s.temperature', 'robot_temperature')}, l.sensor_id, n.sensor_name, n.sensor_type,
  {_r('l.temperature', 'sensor_temperature')}, {_r('l.humidity', 'humidity')}, {_r('l.pressure', 'pressure')}, l.event_time AS last_sensor_time
FROM robot_status s JOIN latest l ON s.robot_id = l.robot_id LEFT JOIN dim_robot d ON d.robot_id = s.robot_id
LEFT JOIN dim_sensor n ON n.sensor_id = l.sensor_id""",
    "sample_systematic": _with(READINGS, _ORDERED) + """SELECT data_id, event_time, robot_id FROM ordered
WHERE total <= 90 OR (i % (total // 90) = 0 AND i < 90 * (total // 90))""",
    "sample_routed": _with(READINGS, ROUTED, """ordered AS (
  SELECT *, row_number() OVER (ORDER BY robot_id) - 1 AS i, count(*) OVER () AS total FROM routed)""") + "SELECT robot_id, "
    + ", ".join(_r(c, c) for c in ("avg_temperature", "max_temperature", "min_temperature", "avg_humidity", "max_humidity",
                                   "min_humidity", "avg_pressure"))
    + ", data_count FROM ordered WHERE total <= 7 OR (i % (total // 7) = 0 AND i < 7 * (total // 7))",
    "sample_head": _with(READINGS) + "SELECT data_id, event_time FROM readings ORDER BY event_time, data_id LIMIT 90",
    "access_log_page": """SELECT CAST(o_orderkey AS VARCHAR) AS log_id, 'user' || CAST(o_custkey AS VARCHAR) AS user_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'query' ELSE 'export' END AS operation, CAST(o_orderkey % 1000 AS INTEGER) AS request_time,
  o_orderdate AS create_time, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50) AS BIGINT) AS pages
FROM orders ORDER BY o_orderdate DESC, log_id DESC LIMIT 50 OFFSET 50""",
    "backup_task_page": _with(BACKUP_TASKS) + "SELECT * FROM backup_tasks ORDER BY start_time DESC, task_id DESC LIMIT 25 OFFSET 25",
    "sensor_types": _with(READINGS) + "SELECT DISTINCT sensor_type FROM readings",
    "active_robots": _with(DIM_ROBOT) + "SELECT robot_id, robot_name, location FROM dim_robot WHERE status = 1",
    "status_by_ids": _with(STATUS) + f"""SELECT robot_id, robot_name, status FROM robot_status
WHERE robot_id IN (SELECT {_code('R', 's_suppkey', 6)} FROM supplier)""",
    "online_robots": _with(STATUS) + "SELECT robot_id FROM robot_status WHERE status = 'ONLINE'",
    "robot_status_counts": _with(STATUS) + "SELECT status, count(*) AS n FROM robot_status GROUP BY status",
    "command_status_counts": _with(COMMANDS) + "SELECT status, count(*) AS n FROM commands GROUP BY status",
    "system_totals": _with(STATUS, COMMANDS) + """SELECT 'total_robots' AS name, count(*) AS n FROM robot_status
UNION ALL SELECT 'online_robots', count(*) FROM robot_status WHERE status = 'ONLINE'
UNION ALL SELECT 'total_commands', count(*) FROM commands""",
    "commands_by_type": _with(COMMANDS) + "SELECT command_type, count(*) AS n FROM commands GROUP BY command_type",
    "command_history": _with(COMMANDS) + """SELECT robot_id, command_id, create_time, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY create_time DESC, command_id DESC) AS position FROM commands)
WHERE position <= 10""",
    "command_latest": _with(COMMAND_EVENTS) + """SELECT command_id, status, event_time, changes FROM (
  SELECT *, row_number() OVER (PARTITION BY command_id ORDER BY event_time DESC, event_seq DESC, status DESC) AS rn,
    count(*) OVER (PARTITION BY command_id) AS changes FROM command_events) WHERE rn = 1""",
    "command_transitions": _with(COMMAND_EVENTS, """linked AS (
  SELECT *, lag(status) OVER (PARTITION BY command_id ORDER BY event_time, event_seq, status) AS previous_status FROM command_events)""") + """
SELECT command_id, event_seq, status, event_time, previous_status,
  (coalesce(previous_status, ''), status) IN (('', 'PENDING'), ('', 'FAILED'), ('PENDING', 'EXECUTED'), ('PENDING', 'FAILED'),
    ('PENDING', 'CANCELLED'), ('FAILED', 'RETRYING'), ('RETRYING', 'PENDING'), ('RETRYING', 'EXECUTED'), ('RETRYING', 'FAILED')) AS legal
FROM linked""",
    "retry_eligible": _with(COMMANDS) + """SELECT command_id, status, retry_count,
  status = 'FAILED' AND retry_count < max_retry AS can_retry FROM commands""",
    "cancellable": _with(COMMANDS) + "SELECT command_id FROM commands WHERE status = 'PENDING'",
    "task_status_after": _with(COMMANDS, STATUS, """moved AS (
  SELECT robot_id, after FROM (
    SELECT robot_id, CASE command_type WHEN 'START_TASK' THEN 'RUNNING' WHEN 'RESUME_TASK' THEN 'RUNNING'
        WHEN 'STOP_TASK' THEN 'STOPPED' WHEN 'PAUSE_TASK' THEN 'PAUSED' END AS after,
      row_number() OVER (PARTITION BY robot_id ORDER BY execute_time DESC, command_id DESC) AS rn
    FROM commands WHERE status = 'EXECUTED' AND command_type <> 'SELF_TEST') WHERE rn = 1)""") + """
SELECT s.robot_id, coalesce(after, task_status) AS task_status FROM robot_status s LEFT JOIN moved m ON s.robot_id = m.robot_id""",
    "command_duration": _with(COMMANDS) + """SELECT command_id, date_sub('second', execute_time, complete_time) AS duration_seconds
FROM commands WHERE complete_time IS NOT NULL""",
    "robot_latest_status": _with(READINGS) + _freshness(_LAST_BEAT),
    "robot_latest_status_all": _with(READINGS, DIM_ROBOT) + _freshness(f"""SELECT coalesce(b.robot_id, d.robot_id) AS robot_id,
  last_update_time, reported_status FROM ({_LAST_BEAT.replace('FROM readings', "FROM readings WHERE sensor_type = 'PRESSURE'")}) b
  FULL JOIN (SELECT DISTINCT robot_id FROM dim_robot) d ON b.robot_id = d.robot_id"""),
    "robot_dim_upsert": _with(DIM_ROBOT, f"""updates AS (
  SELECT {_code('R', 'o_custkey', 6)} AS robot_id, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS status,
    'DOCK-' || substr(o_orderpriority, 1, 1) AS location, o_orderdate AS update_time FROM orders)""", """last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY update_time DESC, location DESC, status DESC) AS rn FROM updates)
  WHERE rn = 1)""") + """SELECT d.robot_id, d.robot_name, coalesce(l.status, d.status) AS status,
  coalesce(l.location, d.location) AS location, coalesce(l.update_time, d.update_time) AS update_time
FROM dim_robot d LEFT JOIN last l ON d.robot_id = l.robot_id""",
    "reading_tags": _with(READINGS) + """SELECT data_id, concat_ws(',', CASE WHEN status <> 'NORMAL' THEN 'anomaly' END,
  CASE WHEN temperature > 100 THEN 'critical' END, 'raw') AS tags FROM readings""",
    "reading_tags_attached": _with(READINGS) + """SELECT data_id, concat_ws(',', CASE WHEN humidity >= 20 AND humidity < 50 THEN 'batch' END,
  CASE WHEN status <> 'NORMAL' THEN 'anomaly' END, CASE WHEN temperature > 100 THEN 'critical' END, 'raw',
  CASE WHEN humidity < 20 THEN 'mine' END) AS tags FROM readings""",
    "subscription_match": _with(READINGS, SUBSCRIPTIONS) + """SELECT subscription_id, data_id FROM readings r JOIN subs s
ON r.robot_id = s.robot_id WHERE s.types IS NULL OR list_contains(s.types, r.sensor_type)
UNION ALL SELECT subscription_id, data_id FROM readings r JOIN subs s ON s.robot_id IS NULL AND (s.types IS NULL OR list_contains(s.types, r.sensor_type))""",
    "status_topics": _with(STATUS) + """SELECT topic, robot_id AS key,
  '{"robot_id":"' || robot_id || '","status":"' || status || '","task_status":"' || task_status || '"}' AS value
FROM (SELECT *, unnest(['/topic/robots/' || robot_id || '/status', '/topic/robots/all/status']) AS topic FROM robot_status)""",
    "alert_topics": _with(STATUS, JUDGED_ROBOTS) + """SELECT topic, robot_id AS key,
  '{"robot_id":"' || robot_id || '","alert_type":"ROBOT_ABNORMAL","severity":"' || severity || '"}' AS value
FROM (SELECT *, unnest(['/topic/robots/' || robot_id || '/alerts', '/topic/alerts']) AS topic FROM graded WHERE abnormal)""",
    "command_topics": _with(COMMANDS) + """SELECT '/topic/robots/' || robot_id || '/commands' AS topic, robot_id AS key,
  '{"command_id":"' || command_id || '","robot_id":"' || robot_id || '","status":"' || status || '"}' AS value FROM commands""",
    "id_format_check": _with(READINGS) + """SELECT data_id, regexp_full_match(robot_id, '[A-Z0-9_#-]+') AS robot_ok,
  regexp_full_match(lower(robot_id), '[A-Z0-9_#-]+') AS lower_ok, regexp_full_match(sensor_type, '[A-Z_]+') AS type_ok,
  regexp_full_match(sensor_id, '[A-Z_]+') AS id_as_type_ok FROM readings""",
    "json_validity": """WITH docs AS (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 2)
    WHEN event_type = 'signup' THEN '[' || props || ']' ELSE props END AS doc FROM events)
SELECT event_id, json_valid(doc) AS is_json, json_valid(doc) AND doc LIKE '{%' AS is_object,
  json_valid(doc) AND doc LIKE '[%' AS is_array FROM docs""",
    "validate_stream": _with(READINGS, f"v AS (SELECT data_id, {_REASON} AS reason FROM readings)")
    + "SELECT data_id, reason IS NULL AS valid, reason FROM v",
    "validate_http": _with(READINGS) + """SELECT data_id, temperature IS NOT NULL AND humidity IS NOT NULL AND pressure IS NOT NULL AS http_ok,
  temperature IS NOT NULL AND humidity IS NOT NULL AND pressure IS NOT NULL AND status = 'NORMAL' AS entity_ok FROM readings""",
    "collect_counts": _with(READINGS) + """SELECT count(*) FILTER (WHERE temperature IS NOT NULL AND humidity IS NOT NULL) AS success_count,
  count(*) FILTER (WHERE temperature IS NULL OR humidity IS NULL) AS fail_count FROM readings""",
    "topic_routing": _with(READINGS) + f"""SELECT 'sensor-data-' || lower(sensor_type) AS topic, robot_id || '#' || sensor_id AS key, data_id,
  {_r('temperature', 'temperature')}, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') AS event_time FROM readings""",
    "metric_map": _with(READINGS) + f"""SELECT data_id, {_r('humidity', 'humidity')}, {_r('temperature', 'temperature')},
  {_r('CAST(1.5 AS DOUBLE)', 'noise')},
  CAST(1 + (temperature IS NOT NULL)::INT + (humidity IS NOT NULL)::INT + (pressure IS NOT NULL)::INT
    + 3 * (position_x IS NOT NULL)::INT AS INTEGER) AS entries FROM readings""",
    "dim_time": _with(READINGS, "m AS (SELECT DISTINCT CAST(date_trunc('minute', event_time) AS TIMESTAMP) AS t FROM readings)") + """
SELECT CAST(strftime(t, '%Y%m%d%H%M%S') AS BIGINT) AS time_key, strftime(t, '%Y-%m-%d') AS full_date, CAST(year(t) AS INTEGER) AS year,
  CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day, CAST(hour(t) AS INTEGER) AS hour, CAST(minute(t) AS INTEGER) AS minute,
  CAST((dayofyear(t) - 1 + isodow(date_trunc('year', t)) - 1) // 7
    + CASE WHEN isodow(date_trunc('year', t)) <= 4 THEN 1 ELSE 0 END AS INTEGER) AS week_of_year,
  CAST(dayofweek(t) + 1 AS INTEGER) AS day_of_week, dayofweek(t) IN (0, 6) AS is_weekend, CAST(quarter(t) AS INTEGER) AS quarter FROM m""",
    "partition_values": _with(READINGS) + """SELECT strftime(event_time, '%Y-%m-%d') AS daily, strftime(event_time, '%Y-%m-%d-%H') AS hourly,
  strftime(event_time, '%Y-%m') AS monthly, count(*) AS n FROM readings GROUP BY 1, 2, 3""",
    "system_performance": _performance(24),
    "system_performance_month": _performance(24 * 31),
    "readings_by_type": _with(READINGS) + "SELECT sensor_type, count(*) AS n FROM readings GROUP BY sensor_type",
    "type_share": _with(READINGS) + f"""SELECT sensor_type, count(*) AS n, {_r('count(*) / (SELECT count(*) FROM readings)', 'share')}
FROM readings GROUP BY sensor_type""",
    "rows_per_second": _with(READINGS) + """SELECT CAST(date_trunc('second', event_time) AS TIMESTAMP) AS "second", count(*) AS n
FROM readings GROUP BY 1""",
    "anomalies_per_hour": _with(READINGS) + """SELECT CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS hour, count(*) AS n, count(*) > 3 AS flagged
FROM readings WHERE temperature < 0 OR temperature > 100 GROUP BY 1""",
    "run_success_rates": f"""WITH t AS (SELECT count(*) AS total_jobs, count(*) FILTER (WHERE l_returnflag <> 'R') AS successful_jobs,
    count(*) FILTER (WHERE l_returnflag = 'R') AS failed_jobs, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_records,
    CAST(sum(CAST(l_quantity AS BIGINT) % 5) AS BIGINT) AS failed_records FROM lineitem)
SELECT *, {_r('successful_jobs / total_jobs * 100', 'success_rate')},
  {_r('(total_records - failed_records) / total_records * 100', 'record_success_rate')} FROM t""",
    "message_rates": f"""WITH t AS (SELECT count(*) AS messages_sent, count(*) FILTER (WHERE l_returnflag <> 'R') AS messages_acked,
    count(*) FILTER (WHERE l_returnflag = 'R') AS messages_failed FROM lineitem)
SELECT *, {_r('messages_acked / messages_sent * 100', 'success_rate')} FROM t""",
    "command_timers": f"""SELECT CASE WHEN l_linestatus = 'O' THEN 'DAILY' ELSE 'WEEKLY' END AS job_type,
  CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS n,
  {_r('sum(l_extendedprice)', 'total_duration', 2)}, {_r('max(l_extendedprice)', 'max_duration', 2)} FROM lineitem GROUP BY 1, 2""",
    "compression_statistics": f"""WITH t AS (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_compressed_files,
    CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_original_size,
    CAST(sum(CAST(floor(l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)) AS BIGINT)) AS BIGINT) AS total_compressed_size
  FROM lineitem WHERE l_linestatus = 'O')
SELECT *, {_r('(1.0 - total_compressed_size / total_original_size) * 100', 'average_ratio')} FROM t""",
    "backup_statistics": _with(BACKUP_TASKS) + """SELECT CAST(sum(backup_size) AS BIGINT) AS total_size, count(*) AS total_count,
  count(*) FILTER (WHERE task_type = 'FULL_BACKUP') AS full_backups, count(*) FILTER (WHERE task_type <> 'FULL_BACKUP') AS incremental_backups,
  max(end_time) AS last_backup_time, CAST(sum(backup_size) // count(*) AS BIGINT) AS average_size FROM backup_tasks""",
    "backup_report": _with(BACKUP_TASKS) + """SELECT count(*) AS total_backups, CAST(sum(backup_size) AS BIGINT) AS total_size,
  CAST(sum(file_count) AS BIGINT) AS total_files, count(*) FILTER (WHERE status = 'COMPLETED') AS succeeded,
  count(*) FILTER (WHERE status <> 'COMPLETED') AS failed
FROM backup_tasks WHERE start_time > '1996-01-01' AND start_time < '2001-01-01'""",
    "retention_keep": _with(READINGS) + "SELECT data_id, event_time FROM readings WHERE event_time >= '2024-01-16'",
    "retention_delete": _with(READINGS) + "SELECT data_id, event_time, robot_id FROM readings WHERE event_time >= '2024-01-16 12:00:00'",
    "cleanup_preview": _with(READINGS) + """SELECT count(*) AS rows_to_delete, count(DISTINCT CAST(event_time AS DATE)) AS affected_partitions,
  min(event_time) AS oldest, max(event_time) AS newest FROM readings WHERE event_time < '2024-01-16'""",
    "storage_stats": _with(READINGS) + f"""SELECT count(*) AS total_rows, count(DISTINCT CAST(event_time AS DATE)) AS partition_count,
  {_r('count(*) / count(DISTINCT CAST(event_time AS DATE))', 'rows_per_day')}, min(event_time) AS oldest, max(event_time) AS latest FROM readings""",
    "incremental_delta": _with(READINGS) + "SELECT data_id, event_time FROM readings WHERE event_time > '2024-01-20'",
    "checksum_differences": """SELECT o_orderkey, CASE WHEN lost THEN 'REMOVED' ELSE 'CHANGED' END AS kind,
  CAST(1 AS BIGINT) AS rows_before, CAST(CASE WHEN lost THEN 0 ELSE 1 END AS BIGINT) AS rows_after
FROM (SELECT o_orderkey, o_custkey % 500 = 7 AND o_orderkey % 2 <> 0 AS lost, o_custkey % 700 = 11 AS changed FROM orders)
WHERE lost OR changed
UNION ALL SELECT -o_orderkey - 1, 'ADDED', 0, 1 FROM orders WHERE o_custkey % 900 = 13""",
    "table_checksum": _with(READINGS, "h AS (SELECT md5(concat_ws('|', " + ", ".join(
        f"coalesce({x}, '\\N')" for x in (
            "data_id", "CAST(epoch_us(event_time) AS VARCHAR)", "robot_id", "sensor_id", "sensor_type", *[
                f"CAST(CAST(round({m} * 1e6) AS BIGINT) AS VARCHAR)" for m in (
                    "temperature", "humidity", "pressure", "position_x", "position_y", "position_z")], "status"))
        + ")) AS row FROM readings)") + """
SELECT substr(row, 1, 1) AS digit, count(*) AS row_count,
  CAST(sum(CAST(CAST('0x' || substr(row, 2, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM h GROUP BY 1""",
    "backup_restore": _with(READINGS) + f"""SELECT data_id, CASE WHEN CAST(data_id AS BIGINT) % 97 <> 0 THEN event_time END AS event_time,
  robot_id, {_r('pressure', 'pressure')} FROM readings""",
    "backup_changed": _with(READINGS, """changed AS (
  SELECT data_id, robot_id, strftime(event_time, '%Y-%m-%d') AS dt,
    CASE WHEN strftime(event_time, '%Y-%m-%d') = '2024-01-10' THEN pressure + 1 ELSE pressure END AS pressure FROM readings)""")
    + f"SELECT data_id, robot_id, dt, {_r('pressure', 'pressure')} FROM changed",
    "partitioned_write": _with(READINGS) + f"""SELECT strftime(event_time, '%Y-%m-%d') AS dt, robot_id, count(*) AS n, {_r('max(pressure)', 'max_pressure')}
FROM readings GROUP BY 1, 2""",
    "bucketed_read": _with(READINGS) + f"SELECT robot_id, count(*) AS n, {_r('max(pressure)', 'max_pressure')} FROM readings GROUP BY robot_id",
    "stream_compacted": _with(READINGS) + f"""SELECT data_id, event_time, robot_id, strftime(event_time, '%Y-%m-%d') AS dt,
  strftime(event_time, '%H') AS hr, {_r('pressure', 'pressure')} FROM readings WHERE status = 'NORMAL' AND ({_REASON}) IS NULL""",
    "compress_in_place": _with(READINGS) + f"""SELECT data_id, robot_id, strftime(event_time, '%Y-%m-%d') AS dt, {_r('pressure', 'pressure')} FROM readings""",
    "compress_rewrite": _with(READINGS) + f"""SELECT data_id, robot_id, strftime(event_time, '%Y-%m-%d') AS dt, {_r('pressure', 'pressure')} FROM readings""",
    "stream_ingest": _with(READINGS) + f"""SELECT data_id, event_time, robot_id, sensor_type, {_r('temperature', 'temperature')},
  {_r('humidity', 'humidity')}, {_r('pressure', 'pressure')} FROM readings WHERE status = 'NORMAL' AND ({_REASON}) IS NULL""",
    "stream_ingest_metrics": _with(READINGS, f"ok AS (SELECT * FROM readings WHERE status = 'NORMAL' AND ({_REASON}) IS NULL)")
    + "\nUNION ALL ".join(f"SELECT data_id, '{m}' AS metric, {_r(m, 'value')} FROM ok WHERE {m} IS NOT NULL" for m in (
        "temperature", "humidity", "pressure", "position_x", "position_y", "position_z")),
    "stream_quarantine": _with(READINGS, f"v AS (SELECT CASE WHEN status <> 'NORMAL' THEN 'not JSON' ELSE {_REASON} END AS reason FROM readings)")
    + "SELECT reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY reason",
    "stream_stats": _with(READINGS, f"v AS (SELECT status <> 'NORMAL' OR ({_REASON}) IS NOT NULL AS bad FROM readings)") + f"""
SELECT count(*) AS total_processed, count(*) FILTER (WHERE bad) AS total_errors,
  {_r('count(*) FILTER (WHERE NOT bad) / count(*) * 100', 'success_rate')} FROM v""",
    "stream_dedup": _with(READINGS) + "SELECT data_id, event_time, robot_id FROM readings",
    "stream_windows": _with(READINGS) + f"""SELECT CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS window_start, sensor_type, count(*) AS n,
  {_r('avg(temperature)', 'avg_temperature')} FROM readings GROUP BY 1, 2""",
    "stream_status_events": _with(READINGS, "beats AS (SELECT robot_id, epoch_us(event_time) AS t FROM readings)",
      "mark AS (SELECT (max(t) // 1000 - 600000) * 1000 AS upto, 21600000000 AS silence FROM beats)", """seen AS (
  SELECT robot_id, t, lag(t) OVER w AS p, lead(t) OVER w AS n, upto, silence FROM beats, mark WHERE t <= upto WINDOW w AS (PARTITION BY robot_id ORDER BY t))""")
    + """SELECT robot_id, 'ONLINE' AS status, make_timestamp(t) AS event_time FROM seen WHERE p IS NULL OR t - p > silence
UNION ALL SELECT robot_id, 'OFFLINE', make_timestamp(t + silence) FROM seen WHERE n - t > silence OR (n IS NULL AND t + silence <= upto)""",
    "stream_status": _with(READINGS) + _freshness(_LAST_BEAT),
    "stream_sustained": _alerts("robot_id") + "SELECT rule_id, robot_id, start_time, severity FROM alerts",
    "stream_sustained_late": _alerts("robot_id") + "SELECT rule_id, robot_id, start_time, severity FROM alerts",
}
