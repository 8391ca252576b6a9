"""Compare a Spark result with a DuckDB result: columns, row count and values, in any order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, datetime):
        return value.date().isoformat()
    if isinstance(value, date):
        return value.isoformat()
    number = float(value)
    return "NaN" if math.isnan(number) else number


def _normal(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_names, got = _normal(list(spark_df.columns), spark_df.collect())
    relation = con.execute(sql)
    want_names, want = _normal([d[0] for d in relation.description], relation.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got == want:
        return None
    only_got, only_want = got - want, want - got
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; {sum(only_got.values())} only here, e.g. "
        f"{sorted(only_got.items(), key=str)[:2]}; {sum(only_want.values())} only there, e.g. "
        f"{sorted(only_want.items(), key=str)[:2]}"
    )
