"""Compare a query with its SQL in DuckDB, as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    def plain(v):
        return None if isinstance(v, float) and v != v else 0.0 if v == 0 and isinstance(v, float) else v

    order = sorted(columns)
    places = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in places) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def expected(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = con.execute(sql)
    return rows([d[0] for d in out.description], out.fetchall())


def found(df):
    return rows(df.columns, df.collect())
