"""Small helpers: evaluate one column expression, plan text, value normalisation."""

import math

from pyspark.sql import functions as F


def evaluate(spark, expr, values, schema="x string"):
    """Values of a column expression over one input column, in input order."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def table(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def ts(x):
    return F.lit(x).cast("timestamp")
