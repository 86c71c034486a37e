"""Run a registered query and its SQL twin on the same files and compare names, types and rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(value) -> str:
    return type(value).__name__


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(cells, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[int, str | None]:
    """Row count and, if anything differs, what."""
    df = fn(spark, sf_dir)
    got_names, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _sorted_rows([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return len(got), f"columns {got_names} / {want_names}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows / {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return len(got), f"row {g} / {w}"
        kinds = [(_kind(a), _kind(b)) for a, b in zip(g, w) if a is not None and b is not None]
        if any(a != b for a, b in kinds):
            return len(got), f"types {kinds}"
    return len(got), None
