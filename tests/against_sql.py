"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same(spark, sf_dir: str, query, sql: str) -> None:
    names, theirs = rows_of_sql(sf_dir, sql)
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    spell = lambda v: repr(v + 0.0) if isinstance(v, float) else repr(v)
    ours = sorted(tuple(map(spell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert ours == sorted(tuple(spell(r[i]) for i in order) for r in theirs)
