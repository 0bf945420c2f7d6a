"""Run a checked query in Spark and its oracle in DuckDB, and compare the rows."""

from __future__ import annotations

import math

import duckdb

SAMPLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in SAMPLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """What differs, empty if nothing does."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    expected = _rows(names, answer.fetchall())
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    if found == expected:
        return []
    only_found = [r for r in found if r not in set(expected)][:limit]
    only_expected = [r for r in expected if r not in set(found)][:limit]
    return [f"rows {len(found)} against {len(expected)}"] + [f"spark {r}" for r in only_found] + [
        f"duckdb {r}" for r in only_expected
    ]
