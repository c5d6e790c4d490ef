"""The access log: filters, retention, and gaps of activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LIMIT, DEFAULT_LIMIT = 1_000, 100


def query(log: DataFrame, user: str | None = None, collection: str | None = None, route: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = DEFAULT_LIMIT, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Newest records first that equal all given filters, between since and until (both included); limit is 1 to MAX_LIMIT."""
    rows = log
    for name, value in (("user", user), ("collection", collection), ("route", route)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    if until is not None:
        rows = rows.where(F.col(ts) <= until)
    return rows.orderBy(F.col(ts).desc(), F.col(seq).desc()).limit(min(max(limit, 1), MAX_LIMIT))


def retained(log: DataFrame, now: Column, max_rows: int = 1_000_000, max_age: str = "90 days", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Records of the last max_age, of which the newest max_rows.

    The cut is found from counts by second, so no task ranks the whole log.
    """
    young = log.where(F.col(ts) >= now - F.expr(f"interval {max_age}"))
    second = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000)
    counts = young.groupBy(second.alias("second")).count()
    day = F.floor(F.col("second") / 86_400)
    days = counts.groupBy(day.alias("day")).agg(F.sum("count").alias("n"))
    newer = days.select("day", (F.sum("n").over(Window.orderBy(F.col("day").desc())) - F.col("n")).alias("after_day"))
    within = F.sum("count").over(Window.partitionBy("day").orderBy(F.col("second").desc())) - F.col("count")
    cuts = counts.withColumn("day", day).withColumn("after", within).join(newer, "day").select("second", (F.col("after") + F.col("after_day")).alias("after")).where(F.col("after") < max_rows)
    rows = young.withColumn("second", second).join(cuts, "second")
    rank = F.row_number().over(Window.partitionBy("second").orderBy(F.col(ts).desc(), F.col(seq).desc()))
    return rows.withColumn("rank", rank).where(F.col("rank") + F.col("after") <= max_rows).drop("second", "after", "rank")


def activity(log: DataFrame, gap: str = "60 seconds", key: str | None = None, ts: str = "ts") -> DataFrame:
    """(key, started, ended, n): stretches of activity that no idle gap interrupts."""
    keys = [F.col(key)] if key else []
    rows = log.groupBy(*keys, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*([key] if key else []), F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
