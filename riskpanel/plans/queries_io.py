"""Registered I/O round trips (K1-K4 with S4, S6-S8) and remaining scalar/column ops.

Each round trip writes through a sink into the shared checkpoint folder and
reads back through the matching source, so the oracle checks both directions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.operators import columns, encoding, panel as panel_ops, position, profile, quality
from riskpanel.plans import proxy
from riskpanel.plans import sqlparts as S
from riskpanel.plans.registry import register, rounded
from riskpanel.session import checkpoint_dir, materialize
from riskpanel.sources import lookups, readers, sinks


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{label}-{uuid.uuid4().hex}"


@register("fold_table_roundtrip", "K1 S4 S5", sql=f"""
WITH {S.population()}
SELECT party_id, startdate, round(a_to_e_value, 6) AS a_to_e_value, fold FROM pop WHERE fold <= 3
""")
def fold_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + S4: members written as a fold-partitioned table, read back with a fold
    filter that prunes partitions (folds 4-5 are never opened)."""
    path = _scratch(spark, "folds")
    sinks.write_folds(proxy.policies(spark, sf_dir).select("party_id", "startdate", "a_to_e_value", "fold"), path)
    back = readers.read_folds(spark, path, max_fold=3)
    return rounded(back.select("party_id", "startdate", "a_to_e_value", F.col("fold").cast("int").alias("fold")))


@register("report_roundtrip", "K2 S6 A2", sql=f"""
WITH {S.population()}
SELECT state, round(avg(a_to_e_value), 6) AS a_to_e_value FROM pop WHERE state IS NOT NULL GROUP BY state
""")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + S6: the state-mean report written as CSV and read back with an explicit schema."""
    path = _scratch(spark, "report")
    sinks.write_report(profile.state_means(proxy.policies(spark, sf_dir), "state", "a_to_e_value"), path,
                       single_file=True)
    return rounded(readers.read_csv(spark, path, "state string, a_to_e_value double"))


@register("zip_map_roundtrip", "K3 S7 P10 B4", sql=f"""
WITH {S.population()},
m AS (SELECT zip, {S.band_case("avg(a_to_e_value)", __import__("riskpanel.functions.binning", fromlist=["x"]).BAND8_EDGES,
                               __import__("riskpanel.functions.binning", fromlist=["x"]).BAND8_LABELS)} AS category
      FROM pop WHERE zip IS NOT NULL GROUP BY zip)
SELECT c.c_custkey AS party_id, CAST(c.c_nationkey AS VARCHAR) AS zip, m.category AS zip_category
FROM customer c LEFT JOIN m ON CAST(c.c_nationkey AS VARCHAR) = m.zip
""")
def zip_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + S7 + P10: the zip -> band map written as JSON, loaded back and applied
    to every member (unmatched zips give NULL)."""
    path = _scratch(spark, "zipmap")
    enc = encoding.encode_by_mean(proxy.policies(spark, sf_dir), "zip", "a_to_e_value")
    sinks.write_map(enc, path, "zip", "category")
    zmap = lookups.load_map(spark, path)
    cust = proxy.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party_id"),
                                                         F.col("c_nationkey").cast("string").alias("zip"))
    return lookups.apply_map(cust, "zip", zmap, out="zip_category")


@register("map_object_roundtrip", "K3 S7", sql="""
SELECT p_name || ' "' || p_partkey || '\\ /' || chr(10) AS key, p_type AS value FROM part
""")
def map_object_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + S7: a map whose keys hold quotes, backslashes and line ends, written as one JSON object and read back."""
    path = _scratch(spark, "map_object")
    part = proxy.table(spark, sf_dir, "part")
    key = F.concat("p_name", F.lit(' "'), F.col("p_partkey").cast("string"), F.lit("\\ /\n"))
    sinks.write_map_object(part.select(key.alias("key"), F.col("p_type").alias("value")), path)
    return lookups.load_map(spark, path)


_YEAR_COLUMNS = ["party_id", "plan", "actual", "expected", "a_to_e_value"]


@register("dated_files", "S4 U1", sql=f"""
WITH {S.LINES}, {S.MEMBERS}, {S.ae("ae")}
SELECT party_id, plan, CASE WHEN startdate <> '1998-01-01' THEN round(actual, 6) END AS actual, round(expected, 6) AS expected,
       round(a_to_e_value, 6) AS a_to_e_value, startdate, {S.fold_expr()} AS fold FROM ae
""")
def dated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + U1: five yearly files named by their date, one of which lacks a column, read in one scan: the date comes from
    the file's name, the missing column is NULL. The claim lines behind them are read once."""
    path = _scratch(spark, "dated")
    years = materialize(proxy.a_to_e(spark, sf_dir), "years")
    for day in proxy.START_DATES:
        columns = [c for c in _YEAR_COLUMNS if not (day == "1998-01-01" and c == "actual")]
        years.where(F.col("startdate") == day).select(columns).write.parquet(f"{path}/train {day}.parquet")
    back = readers.read_dated(spark, path)
    return rounded(back.select(*_YEAR_COLUMNS, "startdate", "fold"))


@register("narrowed_lines", "C3", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS TINYINT) AS l_quantity, l_extendedprice, l_quantity AS quantity_before,
       'tinyint' AS quantity_type, 'double' AS price_type FROM lineitem
""")
def narrowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities in the narrowest type that holds them (whole numbers up to 50), beside their old values;
    prices have fractions and keep their type."""
    li = proxy.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    small = quality.narrow(li, ["l_quantity", "l_extendedprice"])
    types = dict(small.dtypes)
    return small.select("*", F.col("l_quantity").cast(dict(li.dtypes)["l_quantity"]).alias("quantity_before"),
                        F.lit(types["l_quantity"]).alias("quantity_type"), F.lit(types["l_extendedprice"]).alias("price_type"))


@register("beside_by_position", "P13", sql="""
WITH a AS (SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer),
b AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)
SELECT coalesce(a.pos, b.pos) AS pos, c_custkey, c_acctbal, o_orderkey, round(o_totalprice, 2) AS o_totalprice
FROM a FULL JOIN b ON a.pos = b.pos
""")
def beside_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance beside orders by price, the i-th with the i-th; the shorter table ends in NULLs."""
    c = proxy.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = proxy.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(position.beside(c, o, ["c_acctbal", "c_custkey"], ["o_totalprice", "o_orderkey"]), 2)


@register("drop_names_roundtrip", "K4 S8 P2", sql=f"""
WITH {S.population()}
SELECT party_id, startdate, plan, round(a_to_e_value, 6) AS a_to_e_value FROM pop
""")
def drop_names_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 + S8 + P2: a drop list written as a name file, read back, and dropped
    (one listed name does not exist: ignored)."""
    path = _scratch(spark, "names")
    pol = proxy.policies(spark, sf_dir)
    drop = [c for c in pol.columns if c not in ("party_id", "startdate", "plan", "a_to_e_value")] + ["no_such"]
    sinks.write_names(spark, drop, path)
    return rounded(pol.drop(*lookups.load_names(spark, path)))


@register("rows_with_null", "F5 P4", sql=f"""
WITH {S.population()}
SELECT party_id, startdate, fold, claims_3mos, claims_6mos, claims_12mos, round(a_to_e_value, 6) AS a_to_e_value
FROM pop WHERE party_id IS NULL OR fold IS NULL OR claims_3mos IS NULL OR claims_6mos IS NULL
            OR claims_12mos IS NULL OR a_to_e_value IS NULL
""")
def rows_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 over the numeric columns picked by type."""
    pol = proxy.policies(spark, sf_dir)
    num = columns.of_type(pol, ["number"])
    return rounded(quality.rows_with_null(pol.select("startdate", *num), num)
                   .select("party_id", "startdate", "fold", "claims_3mos", "claims_6mos", "claims_12mos",
                           "a_to_e_value"))


@register("score_transforms", "C11", sql=f"""
WITH {S.pairs()}
SELECT party_id, startdate, round(abs(y_prior - y_test), 6) AS abs_error, round(y_test, 2) AS y_test_2dp,
       round(sqrt(y_test), 6) AS sqrt_y, round(y_prior * 100.0, 6) AS prior_pct
FROM pairs
""")
def score_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: abs, round, sqrt and percent on the scored set."""
    p = proxy.score_pairs(spark, sf_dir)
    return rounded(p.select("party_id", "startdate", F.abs(F.col("y_prior") - F.col("y_test")).alias("abs_error"),
                            F.round("y_test", 2).alias("y_test_2dp"), F.sqrt("y_test").alias("sqrt_y"),
                            (F.col("y_prior") * 100.0).alias("prior_pct")))


@register("production_start", "C12 S2", sql="""
SELECT c_mktsegment AS plan, count(*) AS members, strftime(current_date - INTERVAL 12 MONTH, '%Y-%m-%d') AS startdate
FROM customer GROUP BY c_mktsegment
""")
def production_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production start date (today minus one year, month arithmetic)
    stamped on the member counts per plan."""
    c = proxy.table(spark, sf_dir, "customer")
    return (c.groupBy(F.col("c_mktsegment").alias("plan")).agg(F.count(F.lit(1)).alias("members"))
             .withColumn("startdate", panel_ops.default_start()))
