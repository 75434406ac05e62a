"""Run a registered query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].convert_dtypes(convert_string=False, convert_floating=False)
    return pdf.sort_values(list(pdf.columns), ignore_index=True) if len(pdf) else pdf


def compare(con, name: str, df, sql: str) -> list[str]:
    got = _sorted(df.toPandas())
    want = _sorted(con.execute(sql).df())
    problems = []
    if list(got.columns) != list(want.columns):
        return [f"{name}: columns {list(got.columns)} != {list(want.columns)}"]
    if len(got) != len(want):
        return [f"{name}: {len(got)} rows != {len(want)}"]
    for column in got.columns:
        a, b = got[column], want[column]
        if str(a.dtype).replace("datetime64[ns]", "datetime64[us]") != str(b.dtype).replace("datetime64[ns]", "datetime64[us]"):
            problems.append(f"{name}.{column}: type {a.dtype} != {b.dtype}")
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            problems.append(f"{name}.{column}: {int((~same).sum())} values differ, first {a[i]!r} != {b[i]!r}")
    return problems
