"""Compares a DataFrame with DuckDB SQL over the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def assert_same(df, sql: str, sf_dir: str):
    names, wanted = rows_of(sql, sf_dir)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == wanted
