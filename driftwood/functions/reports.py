"""Whole reports, and reports that are made while the caller does other things."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, functions as F

from driftwood.operators import draws

#: The parts of a draw report in their order.
SECTIONS: dict[str, Callable[..., DataFrame]] = {
    "distribution": draws.draw_distribution,
    "frequency": draws.draw_frequency,
    "bayes": draws.draw_bayes,
    "ergodic": draws.draw_ergodic,
    "autocorrelation": draws.draw_autocorrelation,
    "range": draws.draw_range,
    "galois": draws.draw_galois,
    "multifractal": draws.draw_multifractal,
    "chaos": draws.draw_chaos,
    "normalization": draws.draw_normalization,
    "candidates": draws.draw_candidates,
}


def draw_report(series: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(section, result) of a draw history (series_id, pos, number): each row of each part as JSON, and the best combination
    as section critical_path."""
    parts = {name: of(series) for name, of in SECTIONS.items()} | {"critical_path": draws.critical_path(series, confidence)}
    told = (df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("result")) for name, df in parts.items())
    return reduce(DataFrame.unionByName, told)


def start(job: Callable[[], object]) -> Future:
    """The job in a thread of its own that has the caller's Spark properties. done() of what is returned tells without waiting
    whether it has ended; result() waits, and raises what the job raised."""
    out: Future = Future()

    def run() -> None:
        try:
            out.set_result(job())
        except BaseException as e:  # noqa: BLE001 - it is the caller's, who gets it from result()
            out.set_exception(e)

    out.set_running_or_notify_cancel()
    InheritableThread(target=run, daemon=True).start()
    return out
