"""Spark rows against DuckDB rows, in any order."""

import math

import numpy as np

from conftest import SF


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 5)
    return str(x)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def same(spark, duck, query, sql):
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
