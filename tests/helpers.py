"""Comparisons of Spark results with DuckDB's."""

import duckdb


def canonical(rows):
    cells = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    return sorted(map(cells, rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def oracle_rows(sql, sf_dir):
    from pathlib import Path

    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = db.sql(sql)
    names = sorted(found.columns)
    return names, canonical(found.select(*[f'"{n}"' for n in names]).fetchall())


def assert_same(df, sql, sf_dir):
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    assert canonical(tuple(r[n] for n in names) for r in df.collect()) == expected
