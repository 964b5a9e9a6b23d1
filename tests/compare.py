"""Run queries in Spark and their SQL in DuckDB over the same tables, and compare columns and rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np

#: The smallest tables.
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v)
    if isinstance(v, np.integer):
        return int(v)
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def difference(df, con, sql: str) -> str:
    """'' where both agree, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    ours = [tuple(plain(r[c]) for c in order) for r in df.select(*order).collect()]
    at = [names.index(c) for c in order]
    rows = [tuple(plain(r[i]) for i in at) for r in theirs]
    a, b = sorted(ours, key=repr), sorted(rows, key=repr)
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in Spark {str(only[0])[:900]}; only in DuckDB {str(only[1])[:900]}"
