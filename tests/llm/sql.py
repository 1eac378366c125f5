"""Compare a DataFrame with SQL on DuckDB, value by value."""

import math
from collections import Counter
from pathlib import Path


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _counted(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, sql, sf_dir):
    """None when equal, else what differs."""
    import duckdb

    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    ours, theirs = _counted(df.columns, df.collect()), _counted(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    return None if ours == theirs and ours else f"only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
