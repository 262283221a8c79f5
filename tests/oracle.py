"""Compares a registered query with its SQL, as multisets of rows."""

import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, list):
        return str([plain(v) for v in value])
    return str(value)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    with duckdb.connect() as db:
        db.execute("set threads to 4")
        for name in os.listdir(sf_dir):
            db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
        result = db.execute(sql)
        columns = [d[0] for d in result.description]
        at = sorted(range(len(columns)), key=columns.__getitem__)
        theirs = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    differ = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert len(ours) == len(theirs) and not differ, (len(ours), len(theirs), differ[:3])
    return len(ours)
