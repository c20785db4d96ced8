"""A Spark query against its SQL on DuckDB: rows as sorted text, doubles rounded."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    cell = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(repr([cell(v) for v in r]) for r in zip(*[c.to_pylist() for c in table.columns], strict=True))


def check(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    ours, theirs = df.select(cols).toArrow(), con.sql(sql).select(*[duckdb.ColumnExpression(c) for c in cols]).to_arrow_table()
    assert rows(ours) == rows(theirs)
