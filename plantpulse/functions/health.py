"""Abnormal flag, severity and description of a robot status row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plantpulse.functions.columns import as_col

# Limits of the status check.
HOT, VERY_HOT = 80.0, 100.0
LOW_BATTERY, EMPTY_BATTERY = 10.0, 5.0
MAP_HOT, MAP_PRESSURE_LOW, MAP_PRESSURE_HIGH = 100.0, 0.0, 1000.0


def _over(c, limit) -> Column:
    c = as_col(c)
    return F.coalesce((c > limit) & ~F.isnan(c), F.lit(False))


def _under(c, limit) -> Column:
    return F.coalesce(as_col(c) < limit, F.lit(False))


def is_abnormal(temperature="temperature", battery="battery_level", sensors="sensor_data") -> Column:
    """Hot, low on battery, or any temperature/pressure entry of the map out of range.

    A row without a sensor map is never abnormal, whatever its other values.
    """
    sensors = as_col(sensors)

    def entry_bad(e):
        hot = e["key"].contains("temperature") & _over(e["value"], MAP_HOT)
        off = e["key"].contains("pressure") & (
            _under(e["value"], MAP_PRESSURE_LOW) | _over(e["value"], MAP_PRESSURE_HIGH)
        )
        return hot | off

    by_map = F.coalesce(F.exists(F.map_entries(sensors), entry_bad), F.lit(False))
    return sensors.isNotNull() & (_over(temperature, HOT) | _under(battery, LOW_BATTERY) | by_map)


def severity(temperature="temperature", battery="battery_level", sensors="sensor_data") -> Column:
    return (
        F.when(~is_abnormal(temperature, battery, sensors), "NORMAL")
        .when(_over(temperature, VERY_HOT), "CRITICAL")
        .when(_under(battery, EMPTY_BATTERY), "HIGH")
        .otherwise("MEDIUM")
    )


def description(temperature="temperature", battery="battery_level") -> Column:
    t, b = as_col(temperature), as_col(battery)
    hot = F.when(_over(t, HOT), F.concat(F.lit("Temperature too high: "), t.cast("string"), F.lit("°C; ")))
    low = F.when(_under(b, LOW_BATTERY), F.concat(F.lit("Battery too low: "), b.cast("string"), F.lit("%; ")))
    return F.concat(F.coalesce(hot, F.lit("")), F.coalesce(low, F.lit("")))
