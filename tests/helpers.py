import datetime as dt

from pyspark.sql import functions as F


def frame(spark, cols: dict, symbol="T", start="2023-01-01", step_days=1):
    """Literal test frame with symbol / daily ts columns."""
    n = len(next(iter(cols.values())))
    rows = []
    base = dt.datetime.fromisoformat(start)
    for i in range(n):
        rows.append(tuple([symbol, base + dt.timedelta(days=i * step_days)] + [cols[c][i] for c in cols]))
    schema = "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def col_list(df, c, order="ts"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]
