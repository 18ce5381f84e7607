"""Run a registered query and its SQL, and compare them as multisets of rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def compare(spark_df, con, sql):
    """None when equal, else a short account of the difference."""
    names = sorted(spark_df.columns)
    ours = [tuple(_cell(r[n]) for n in names) for r in spark_df.collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    place = [theirs_names.index(n) for n in names]
    theirs = [tuple(_cell(r[i]) for i in place) for r in cursor.fetchall()]
    if sorted(ours) == sorted(theirs):
        return None if ours else "no rows"
    extra, missing = sorted(set(ours) - set(theirs))[:2], sorted(set(theirs) - set(ours))[:2]
    return f"{len(ours)} rows against {len(theirs)}; {names}: only ours {str(extra)[:500]}; only SQL {str(missing)[:500]}"
