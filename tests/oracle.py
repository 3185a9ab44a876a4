"""Rows of a query and of its SQL, in a common form."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def common(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        if isinstance(v, (bool,)):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return f"{float(v):.9g}"
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))
