import math
from decimal import Decimal


def canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if isinstance(v, Decimal):
        return (2, repr(float(v)))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    return (5, repr(v))


def rows_of(df):
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in df.collect())


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall()), sorted(cols)
