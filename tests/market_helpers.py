"""Small helpers of the tests."""

import pandas as pd


def pdf(df, *sort):
    out = df.toPandas()
    return out.sort_values(list(sort)).reset_index(drop=True) if sort else out


def days(n, start="2024-01-01"):
    return [d.date().isoformat() for d in pd.bdate_range(start, periods=n)]
