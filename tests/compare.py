"""Compare Spark answers with the independent SQL answers on the same parquet tables."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value) if value is not None else None


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((c is None, c or "") for c in r))


def differences(spark_df, con, sql: str) -> list[str]:
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    notes = []
    spark_kind = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    for name, kind in spark_df.dtypes:
        if spark_kind.get(kind, kind) != kinds[name]:
            notes.append(f"type of {name}: {kind} != {kinds[name]}")
    ours = canonical(spark_df.columns, spark_df.collect())
    theirs = canonical(names, relation.fetchall())
    if len(ours) != len(theirs):
        notes.append(f"rows {len(ours)} != {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        notes.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return notes
