"""Registered queries over the test tables, each with its DuckDB oracle.

Every query reads the given tables in full (no key subsets, no row caps);
limits appear only where a top-k or a page is the operator itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.operators import evaluate, joins, reshape
from riskpanel.operators import panel as panel_ops
from riskpanel.sources import readers
from riskpanel.plans import proxy
from riskpanel.plans import sqlparts as S
from riskpanel.plans.registry import register, rounded

# ---------------------------------------------------------------- evaluation


@register("acceptance_curve", "T9 J7 W2 T14", sql=f"""
WITH {S.pairs()},
{S.edges()},
long AS (SELECT 'y_prior' AS score_name, y_prior AS s, y_test AS m FROM pairs
         UNION ALL SELECT 'y_blend', y_blend, y_test FROM pairs),
{S.curve_select("long")}
""")
def acceptance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: acceptance rate versus mean A/E for two prior-year scores."""
    pairs = proxy.score_pairs(spark, sf_dir)
    return rounded(evaluate.threshold_curve(pairs, ["y_prior", "y_blend"], "y_test"))


@register("acceptance_curve_truth", "T9b", sql=f"""
WITH {S.pairs()},
{S.edges()},
long AS (SELECT 'y_test' AS score_name, y_test AS s, y_prior AS m FROM pairs),
{S.curve_select("long")}
""")
def acceptance_curve_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on the truth, mean of the prediction."""
    pairs = proxy.score_pairs(spark, sf_dir)
    return rounded(evaluate.threshold_curve(pairs, ["y_test"], "y_prior"))


# --------------------------------------------------------------------- panel

PANEL_IDS = ["party_id", "startdate", "fold", "plan", "state", "zip", "gender", "marketing_channel",
             "tobacco_usage_ind", "claims_3mos", "claims_6mos", "claims_12mos", "a_to_e_value"]


def _block_long(wide: DataFrame) -> DataFrame:
    feats = [c for c in wide.columns if c not in ("party_id", "startdate")]
    return rounded(reshape.melt(wide, ["party_id", "startdate"], feats, "feature", "value"))


@register("pivot_diagnosis", "A1 S5 P5", sql=f"""
WITH {S.LINES}, {S.icd_long()},
{S.block_long("icdp", "icd", S.DOM_CCSR, ["ccsr_3mos", "ccsr_6mos", "ccsr_12mos"])}
SELECT party_id, startdate, feature, round(value, 6) AS value FROM icdp_long
""")
def pivot_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: 3/6/12-month diagnosis sums pivoted over the full category domain
    (one unused code included), checked cell by cell in long form."""
    return _block_long(proxy.pivots(spark, sf_dir)["icd"])


@register("pivot_procedures", "A1", sql=f"""
WITH {S.LINES}, {S.cpt_lines()}, {S.CPT_LONG},
{S.block_long("cptp", "cpt", S.DOM_CCS, ["ccs_3mos", "ccs_6mos", "ccs_12mos"])}
SELECT party_id, startdate, feature, round(value, 6) AS value FROM cptp_long
""")
def pivot_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: procedure-code line counts over the three windows."""
    return _block_long(proxy.pivots(spark, sf_dir)["cpt"])


@register("pivot_drg", "A1 F3 C7", sql=f"""
WITH {S.LINES}, {S.cpt_lines()}, {S.DRG_LONG},
{S.block_long("drgp", "drg", S.DOM_DRG, ["drg_los"])}
SELECT party_id, startdate, feature, round(value, 6) AS value FROM drgp_long
""")
def pivot_drg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 on the nullable DRG code (rows without a code dropped, F3)."""
    return _block_long(proxy.pivots(spark, sf_dir)["drg"])


@register("training_panel", "J1 J2 U2 E1 W1", sql=f"""
WITH {S.panel_long()}
SELECT {", ".join(c for c in PANEL_IDS if c != "a_to_e_value")}, round(a_to_e_value, 6) AS a_to_e_value,
       feature, round(value, 6) AS value
FROM panel_long
""")
def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies ⟕ diagnosis ⟕ DRG ⟕ procedures ⋈ outcome for five start dates,
    checked in long form (U2 keeps the NULL cells of members without claims)."""
    domains = proxy.code_domains(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in proxy.feature_names(domains)])
    rows = rounded(proxy.panel_values(spark, sf_dir, proxy.START_DATES, domains))
    value = F.col("value")  # most cells are zeros, which rounding leaves alone
    return rows.select(*PANEL_IDS, F.posexplode("values").alias("__i", "value")) \
        .select(*PANEL_IDS, F.element_at(names, F.col("__i") + 1).alias("feature"),
                F.when(value == 0, F.lit(0.0)).otherwise(F.round(value, 6)).alias("value"))


@register("panel_wide", "E1 A1 J1 J2 P13")
def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 as used downstream: the wide panel (one column per code and window).
    Its values are oracle-checked cell by cell through ``training_panel``."""
    return proxy.panel(spark, sf_dir)


@register("latest_order", "W1 O1", sql="""
SELECT o_custkey AS party_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority, o_orderstatus, round(o_totalprice, 6) AS o_totalprice
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order per member (date desc, key desc) as a skew-safe max_by aggregate."""
    o = proxy.table(spark, sf_dir, "orders")
    lt = panel_ops.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                                  ["o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"])
    return rounded(lt.select(F.col("o_custkey").alias("party_id"), "o_orderkey",
                             F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
                             "o_orderpriority", "o_orderstatus", "o_totalprice"))


@register("first_nonnull_order", "A6", sql="""
WITH o AS (
  SELECT o_custkey, o_orderkey, o_orderpriority,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS f_price,
         CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus END AS urgent_status
  FROM orders)
SELECT o_custkey AS party_id,
       arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority IS NOT NULL) AS o_orderpriority,
       round(arg_min(f_price, o_orderkey) FILTER (WHERE f_price IS NOT NULL), 6) AS f_price,
       arg_min(urgent_status, o_orderkey) FILTER (WHERE urgent_status IS NOT NULL) AS urgent_status
FROM o GROUP BY o_custkey
""")
def first_nonnull_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-null value per column and member, in order-key order."""
    o = proxy.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("f_price"),
        F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus")).alias("urgent_status"))
    first = panel_ops.first_per_key(o, ["o_custkey"], "o_orderkey")
    return rounded(first.withColumnRenamed("o_custkey", "party_id"))


@register("member_segments", "F1 F2 F4 P1 P7 U4", sql=f"""
WITH {S.MEMBERS}
SELECT DISTINCT plan, state, gender, 'policies' AS source
FROM members WHERE plan IN {S.in_list(proxy.KEPT_PLANS)} AND c_acctbal > 0 AND starts_with(state, 'A')
""")
def member_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan IN-list, comparison and prefix filters, projection, constant column, DISTINCT."""
    m = proxy.members(spark, sf_dir)
    return (m.where(F.col("plan").isin(proxy.KEPT_PLANS) & (F.col("c_acctbal") > 0)
                    & F.col("state").startswith("A"))
             .select("plan", "state", "gender", F.lit("policies").alias("source")).distinct())


SEGMENT_TEMPLATE = """
SELECT c.c_mktsegment AS plan, CAST(count(*) AS BIGINT) AS orders, round(sum(o.o_totalprice), 6) AS total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate BETWEEN :start AND :stop AND RIGHT(c.c_name, 3) <> :skip AND c.c_mktsegment IS NOT NULL
GROUP BY c.c_mktsegment"""


@register("sql_template", "S1 S2 F6 C7", sql=SEGMENT_TEMPLATE.format(orders="orders", customer="customer")
          .replace(":start", "TIMESTAMP '1997-01-01 00:00:00'").replace(":stop", "TIMESTAMP '1997-12-31 00:00:00'")
          .replace(":skip", "'000'"))
def sql_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameterised SQL template run on Spark's catalog; values bound, not formatted."""
    proxy.table(spark, sf_dir, "orders").createOrReplaceTempView("rp_orders")
    proxy.table(spark, sf_dir, "customer").createOrReplaceTempView("rp_customer")
    text = SEGMENT_TEMPLATE.format(orders="rp_orders", customer="rp_customer")
    import datetime as dt
    return readers.sql_template(spark, text, start=dt.datetime(1997, 1, 1), stop=dt.datetime(1997, 12, 31),
                                skip="000")


@register("valid_period_join", "J6", sql="""
WITH periods AS (SELECT o_custkey AS party_id, min(o_orderdate) AS valid_from, max(o_orderdate) AS valid_to
                 FROM orders GROUP BY 1),
facts AS (SELECT o.o_custkey AS party_id, l.l_shipdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT f.party_id, CAST(count(*) AS BIGINT) AS n_lines
FROM facts f JOIN periods p ON f.party_id = p.party_id AND f.l_shipdate BETWEEN p.valid_from AND p.valid_to
GROUP BY f.party_id
""")
def valid_period_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join on member plus a BETWEEN on the member's active period."""
    o = proxy.table(spark, sf_dir, "orders")
    li = proxy.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    periods = o.groupBy(F.col("o_custkey").alias("party_id")).agg(
        F.min("o_orderdate").alias("valid_from"), F.max("o_orderdate").alias("valid_to"))
    facts = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey) \
              .select(F.col("o_custkey").alias("party_id"), "l_shipdate")
    j = joins.join_valid_at(facts, periods, "party_id", "l_shipdate", "valid_from", "valid_to")
    return j.groupBy("party_id").agg(F.count(F.lit(1)).alias("n_lines"))


_YEARS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01"]


@register("stacked_outcomes", "U1 S4", sql=f"""
WITH {S.LINES}, {S.MEMBERS}, {", ".join(S.ae("ae" + y[2:4], [y]) for y in _YEARS)}
SELECT party_id, startdate, plan, round(actual, 6) AS actual, round(expected, 6) AS expected,
       round(a_to_e_value, 6) AS a_to_e_value FROM ae96
""" + "".join(f"""
UNION ALL
SELECT party_id, startdate, plan, NULL, NULL, round(a_to_e_value, 6) FROM ae{y[2:4]}
""" for y in _YEARS[1:]))
def stacked_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name of the yearly frames, the first of which has more columns
    (missing -> NULL). The claim lines of all years are joined once; a year is a filter on the written outcomes."""
    outcomes = proxy.a_to_e(spark, sf_dir)
    years = [outcomes.where(F.col("startdate") == y) for y in proxy.START_DATES]
    slim = [y.select("party_id", "startdate", "plan", "a_to_e_value") for y in years[1:]]
    return rounded(panel_ops.stack([years[0], *slim]))


from riskpanel.plans import queries_profile  # noqa: E402,F401  (registers more queries)
from riskpanel.plans import queries_select  # noqa: E402,F401
from riskpanel.plans import queries_fair  # noqa: E402,F401
from riskpanel.plans import queries_ml  # noqa: E402,F401
from riskpanel.plans import queries_io  # noqa: E402,F401
