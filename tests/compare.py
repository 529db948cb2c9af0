"""Compare named queries with their SQL counterparts."""

import glob
import math
import os


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value)) if False else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
