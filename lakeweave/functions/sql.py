"""The library's scalar functions as SQL functions of a session, chunkers as table functions, and an aggregate.

Scalar functions are SQL bodies: Catalyst inlines them, so a query that calls one stays in generated code. The aggregate
sees one group at a time as a whole, in Arrow batches: for groups that fit a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: name: (parameters, result, body, what it computes)
SCALARS = {
    "lw_fee": ("cents BIGINT", "BIGINT", "CAST(cents * 5 / 100 AS BIGINT)", "the platform's share, truncated"),
    "lw_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)", "inner product"),
    "lw_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D)",
        "cosine, 0 for a zero vector",
    ),
    "lw_risk_level": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END", "risk label"),
    "lw_confidence": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END", "confidence label"),
    "lw_masked": ("t STRING, n INT", "STRING", "CASE WHEN length(t) <= 2 * n THEN repeat('*', length(t)) ELSE left(t, n) || repeat('*', length(t) - 2 * n) || right(t, n) END", "both ends kept"),
    "lw_pseudonym": ("t STRING", "STRING", "'PSEUDO_' || left(sha2(t, 256), 12)", "stable pseudonym"),
    "lw_preview": ("t STRING, n INT", "STRING", "left(trim(regexp_replace(t, '\\\\s+', ' ')), n)", "white space as one blank, cut"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for name, (parameters, result, body, _) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    ship_package(spark)

    @F.udtf(returnType="start_char: int, end_char: int, content: string")
    class Chunks:
        def eval(self, text: str):
            from lakeweave.operators.chunking import sliding

            text = text or ""
            for start, stop, _ in sliding(text):
                yield start, stop, text[start:stop]

    spark.udtf.register("lw_chunks", Chunks)

    @F.pandas_udf("double")
    def geometric_mean(values: pd.Series) -> float:
        return float(np.exp(np.log(values[values > 0]).mean())) if (values > 0).any() else None

    spark.udf.register("lw_geometric_mean", geometric_mean)
    return [*SCALARS, "lw_chunks", "lw_geometric_mean"]


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, parameters, result, about) of the scalar functions."""
    return spark.createDataFrame([(n, p, r, about) for n, (p, r, _, about) in SCALARS.items()], "name string, parameters string, result string, about string")
