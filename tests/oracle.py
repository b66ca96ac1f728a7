"""Comparison of a Spark result with DuckDB on the same tables, whatever the order of rows and columns."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(frame, columns):
    frame = frame[columns].copy()
    for c in columns:
        if pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype(float).round(6)
        frame[c] = frame[c].astype(object).where(frame[c].notna(), None).map(str)
    return frame.sort_values(columns).reset_index(drop=True)


def assert_same(spark_frame, duck_frame):
    columns = sorted(duck_frame.columns)
    assert columns == sorted(spark_frame.columns)
    pd.testing.assert_frame_equal(plain(spark_frame, columns), plain(duck_frame, columns))
