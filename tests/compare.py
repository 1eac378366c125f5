"""Compare a query with its SQL, value by value, on DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

from vacancyledger.plans.catalog import oracle_sql, queries


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    import duckdb

    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if ours == theirs:
        return None if ours else "no rows"
    extra, lacking = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours {extra}; only SQL {lacking}"
