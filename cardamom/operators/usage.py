"""What sessions cost: connected minutes and records shown by format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def costs(events: DataFrame, per_minute: str, rates: DataFrame) -> DataFrame:
    """(session, minutes, connect_cost, show_cost, total) from (session, ts, format) and (format, rate), rate null where none is charged."""
    per = events.groupBy("session", "format").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    priced = per.join(rates, "format", "left").withColumn("cost", F.col("n") * F.coalesce(F.col("rate").cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")))
    s = priced.groupBy("session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("cost").alias("show_cost"))
    seconds = F.unix_micros("b") - F.unix_micros("a")
    minutes = F.ceil(seconds / F.lit(60_000_000)).cast("long")
    connect = (minutes.cast("decimal(18,0)") * F.lit(per_minute).cast("decimal(10,2)")).cast("decimal(20,2)")
    out = s.select("session", minutes.alias("minutes"), connect.alias("connect_cost"), F.col("show_cost").cast("decimal(20,2)").alias("show_cost"))
    return out.withColumn("total", (F.col("connect_cost") + F.col("show_cost")).cast("decimal(20,2)"))


def by_format(events: DataFrame, rates: DataFrame) -> DataFrame:
    """(format, n, cost): one line per format that has a rate."""
    n = events.groupBy("format").agg(F.count("*").alias("n"))
    return n.join(rates, "format").where("rate is not null").select("format", "n", (F.col("n") * F.col("rate").cast("decimal(10,2)")).cast("decimal(20,2)").alias("cost"))
