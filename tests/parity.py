"""Spark-versus-DuckDB comparison in the shape of the driver's check:
row count, column names, and an order-insensitive hash of the values with
columns sorted by name."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def row_hashes(cols: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(hashlib.md5(repr(tuple(_norm(r[i]) for i in order)).encode()).hexdigest() for r in rows)


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint", "TINYINT": "tinyint",
                 "DATE": "date"}


def compare(spark, con, build, sql: str, sf_dir: str) -> dict:
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_types = dict(sdf.dtypes)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "names_match": sorted(s_cols) == sorted(d_cols), "types_match": s_types == d_types}
    if not out["types_match"]:
        out["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                            if s_types.get(c) != d_types.get(c)}
    if out["names_match"]:
        hs, hd = row_hashes(s_cols, s_rows), row_hashes(d_cols, d_rows)
        out["values_match"] = hs == hd
        if hs != hd:
            order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
            order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
            ss = sorted(repr(tuple(_norm(r[i]) for i in order_s)) for r in s_rows)
            dd = sorted(repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows)
            diff_s = [x for x in ss if x not in set(dd)][:3]
            diff_d = [x for x in dd if x not in set(ss)][:3]
            out["sample_spark_only"] = diff_s
            out["sample_oracle_only"] = diff_d
    else:
        out["spark_cols"] = sorted(s_cols)
        out["oracle_cols"] = sorted(d_cols)
    out["ok"] = (out["spark_rows"] == out["oracle_rows"] and out["names_match"] and out["types_match"]
                 and out.get("values_match", False))
    return out
