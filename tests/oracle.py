"""Runs a query beside its oracle SQL and compares the rows, in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 9)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def expected(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return rows(con.sql(sql).df())
