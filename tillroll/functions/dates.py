"""Calendar attributes of a date column (the date dimension's columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_attributes(d: Column) -> list[Column]:
    """Year, Quarter, Month, MonthName, Week (ISO), Day, Weekday (Monday=0),
    WeekdayName, IsWeekend (0/1)."""
    weekday = F.weekday(d)  # 0 = Monday ... 6 = Sunday (not dayofweek: 1 = Sunday)
    return [
        F.year(d).alias("Year"),
        F.quarter(d).alias("Quarter"),
        F.month(d).alias("Month"),
        F.date_format(d, "MMMM").alias("MonthName"),
        F.weekofyear(d).alias("Week"),
        F.dayofmonth(d).alias("Day"),
        weekday.alias("Weekday"),
        F.date_format(d, "EEEE").alias("WeekdayName"),
        weekday.isin(5, 6).cast("int").alias("IsWeekend"),
    ]
