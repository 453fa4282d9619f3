"""Compares a query's rows with DuckDB's over the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    return sorted(repr([None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r]) for r in df[columns].astype(object).itertuples(index=False))


def same(spark_df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(sql).df(), spark_df.toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(want, columns) == rows(got, columns)
