"""Comparison of a Spark result with DuckDB's."""

import math


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if hasattr(x, "asDict"):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
    assert got == want
