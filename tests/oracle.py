"""Compare a query with its DuckDB counterpart on the same Parquet tables."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf_dir, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = query(spark, sf_dir), c.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    picked = ", ".join(f'"{x}"' for x in columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(map(tuple, rel.project(picked).fetchall()))
