"""Registered queries: name -> callable(spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = ""):
    """Register a query under ``name``, with its SQL twin where SQL can express it.

    ``dates`` lists date columns of the result, which both sides return as yyyy-MM-dd strings.
    """
    days = dates.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({d: df[d].cast("string") for d in days}) if days else df

        QUERIES[name] = run
        if sql is not None:
            texts = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in days)
            ORACLES[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if days else sql
        return f

    return add


from . import more_queries, panel_queries, source_queries, study_queries, text_queries  # noqa: E402,F401
from . import analysis_queries, event_queries, network_queries, path_queries, shock_queries, speaker_queries, speech_queries  # noqa: E402,F401
