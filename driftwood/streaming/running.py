"""Running statistics and histograms of series that arrive as a stream, as mergeable sums that Spark keeps as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_statistics(stream: DataFrame) -> DataFrame:
    """n, mean, population standard deviation, least and largest of each series so far. For update or complete mode."""
    return stream.groupBy("series_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_dev"), F.min("value").alias("min"), F.max("value").alias("max"))


def windowed_statistics(stream: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """The same for each time window of ts; rows later than `late` behind the newest are dropped, and a window's state goes
    when no row can come any more."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy("series_id", span.alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_dev")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std_dev")


def running_histogram(stream: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins over a fixed range, for tests of fit on what has come so far; values outside are in the outer bins."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / ((high - low) / bins)).cast("int")))
    return stream.groupBy("series_id", place.alias("bin")).count()


def chi_squared_of(histogram: DataFrame, bins: int) -> DataFrame:
    """Chi-squared against uniformity of a histogram's counts (a batch frame, such as a sink's table)."""
    sums = histogram.groupBy("series_id").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"))
    return sums.select("series_id", "n", (F.col("squares") * bins / F.col("n") - F.col("n")).alias("chi_squared"), F.lit(bins - 1).alias("dof"))


def resettable_statistics(stream: DataFrame) -> DataFrame:
    """The current result of each series after each batch: series_id, n, mean, std_dev, min, max since its last reset.

    The stream has series_id, ts, value and reset; a row with reset true starts the series anew, its own value left out.
    Rows of a batch count in the order of ts. The state of a series is five numbers.
    """
    schema = "n long, mean double, m2 double, low double, high double"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, low, high = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"))
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for value, reset in zip(rows["value"].tolist(), rows["reset"].tolist(), strict=True):
            if reset:
                n, mean, m2, low, high = 0, 0.0, 0.0, float("inf"), float("-inf")
            elif value is not None and value == value:
                n += 1
                away = value - mean
                mean += away / n
                m2 += away * (value - mean)
                low, high = min(low, value), max(high, value)
        state.update((n, mean, m2, low, high))
        yield pd.DataFrame([(key[0], n, mean, (m2 / n) ** 0.5, low, high) if n else (key[0], 0, None, None, None, None)], columns=["series_id", "n", "mean", "std_dev", "min", "max"])

    out = "series_id string, n long, mean double, std_dev double, min double, max double"
    return stream.select("series_id", "ts", "value", "reset").groupBy("series_id").applyInPandasWithState(step, out, schema, "update", GroupStateTimeout.NoTimeout)
