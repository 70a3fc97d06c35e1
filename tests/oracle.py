"""Spark results against DuckDB on the same Parquet files."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def _kind(x: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(x, x)


def compare(df, db, sql):
    """None if equal; otherwise what differs."""
    names = sorted(df.columns)
    got = sorted(([_plain(r[n]) for n in names] for r in df.collect()), key=repr)
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    odd = [(n, k, kinds[n]) for n, k in df.dtypes if not kinds[n].startswith("DECIMAL") and _kind(k) != kinds[n]]
    want = sorted(([_plain(float(v) if type(v).__name__ == "Decimal" else v) for v in (dict(zip(columns, r, strict=True))[n] for n in names)] for r in cursor.fetchall()), key=repr)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
        return f"{len(got)} and {len(want)} rows; {names}; {bad[:3]}"
    return f"types {odd}" if odd else None
