"""Figures of runs and requests, and rows of table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests (duration in seconds, status) in one row: how many, how many failed (400 or over), average and longest in ms to one place; zeros of none."""
    ms = lambda c: F.coalesce(F.round(c * 1000, 1), F.lit(0.0))
    return requests.agg(
        F.count("*").alias("requests_total"), F.count_if(F.col("status") >= 400).alias("errors_total"), ms(F.avg("duration")).alias("latency_avg_ms"), ms(F.max("duration")).alias("latency_max_ms")
    )


def run_progress(results: DataFrame, total: int, elapsed: float, input_price: float, output_price: float) -> DataFrame:
    """Results (status, calls, input_tokens, output_tokens) so far in one row.

    Only those with status ok count calls and tokens; skipped ones are done too,
    all others have failed. cost: tokens by their prices. remaining: the seconds
    of what is left of `total`, at the rate so far; null before the first."""
    ok = F.col("status") == "ok"
    sums = results.agg(
        F.count("*").alias("done"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        *(F.coalesce(F.sum(F.when(ok, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long").alias(c) for c in ("calls", "input_tokens", "output_tokens")),
    )
    cost = F.col("input_tokens") * input_price + F.col("output_tokens") * output_price
    return sums.withColumns({"failed": F.col("done") - F.col("ok") - F.col("skipped"), "cost": cost, "remaining": F.when(F.col("done") > 0, F.lit(elapsed) / F.col("done") * (total - F.col("done")))})


def clustered(cells: Column, within: float = 12.0) -> Column:
    """Cells (structs with top and x0) as rows of a table, top down, each row from left to right.

    A cell begins a row if it lies more than `within` below the first cell of
    the row before: a fold, since that depends on where the row began."""
    kind = "array<array<struct<top:double,x0:double,value:string>>>"
    placed = F.array_sort(F.transform(cells, lambda c: F.struct(c["top"].cast("double").alias("top"), c["x0"].cast("double").alias("x0"), c["value"].cast("string").alias("value"))))

    def add(rows: Column, c: Column) -> Column:
        last = F.get(rows, F.size(rows) - 1)  # null if there is no row yet
        same = F.abs(c["top"] - F.get(last, F.lit(0))["top"]) <= within
        return F.when(same, F.concat(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), F.array(F.concat(last, F.array(c))))).otherwise(F.concat(rows, F.array(F.array(c))))

    rows = F.aggregate(placed, F.array().cast(kind), add)
    return F.transform(rows, lambda row: F.array_sort(row, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0)))
