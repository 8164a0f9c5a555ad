"""Order-free comparison of a Spark result with a DuckDB one."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def same(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    left = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert left == right
