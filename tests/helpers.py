"""What tests share."""

from pathlib import Path

SF = "/root/testdata/sf0.001"


def same_as_sql(df, sql: str, sf_dir: str) -> None:
    """Rows of ``df`` equal those of DuckDB over the same tables, in any order."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    key = lambda r: tuple((v is None, round(v, 6) if isinstance(v, float) else v) for v in r)
    mine = sorted(key(tuple(r[c] for c in names)) for r in df.collect())
    theirs = sorted(key(r) for r in want.select(*names).fetchall())
    assert mine == theirs
