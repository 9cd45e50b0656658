"""DuckDB-dialect SQL building blocks for the oracle side of the registry.

They restate the proxy mapping of ``riskpanel.plans.proxy`` in plain SQL
(theta joins and windows are fine here: the oracle runs on sf0.01 only).
"""

from __future__ import annotations

from collections.abc import Sequence

from riskpanel.plans.proxy import KEPT_PLANS, PRIOR_START, START_DATES


def starts_values(starts: Sequence[str]) -> str:
    rows = ", ".join(f"(DATE '{s}')" for s in sorted(starts))
    return f"(VALUES {rows}) s(startdate)"


def fold_expr(col: str = "startdate", starts: Sequence[str] = START_DATES) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(sorted(starts)))
    return f"CAST(CASE {col} {arms} END AS INTEGER)"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


LINES = """lines AS (
  SELECT o.o_custkey AS party_id, CAST(o.o_orderdate AS DATE) AS odate, o.o_orderkey,
         l.l_extendedprice * (1 - l.l_discount) AS revenue, l.l_quantity, l.l_returnflag,
         p.p_type, p.p_brand, p.p_size
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

MEMBERS = """members AS (
  SELECT c.c_custkey AS party_id, c.c_mktsegment AS plan, r.r_name AS state,
         CAST(c.c_nationkey AS VARCHAR) AS zip,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c.c_acctbal
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def ae(name: str = "ae", starts: Sequence[str] = START_DATES) -> str:
    return f"""{name} AS (
  SELECT a.party_id, a.startdate, m.plan, a.actual,
         avg(a.actual) OVER (PARTITION BY m.plan, a.startdate) AS expected,
         a.actual / avg(a.actual) OVER (PARTITION BY m.plan, a.startdate) AS a_to_e_value
  FROM (SELECT l.party_id, strftime(s.startdate, '%Y-%m-%d') AS startdate, sum(l.revenue) AS actual
        FROM lines l JOIN {starts_values(starts)}
          ON l.odate >= s.startdate AND l.odate < s.startdate + INTERVAL 12 MONTH
        GROUP BY ALL) a
  JOIN members m USING (party_id))"""


def pairs(starts: Sequence[str] = START_DATES, prior: str = PRIOR_START,
          plans: Sequence[str] = KEPT_PLANS) -> str:
    """CTEs ending in ``pairs`` (the scored set of ``proxy.score_pairs``)."""
    all_starts = sorted(set(starts) | {prior})
    return f"""{LINES},
{MEMBERS},
{ae("ae_all", all_starts)},
aes AS (SELECT a.*, m.state FROM ae_all a JOIN members m USING (party_id)
        WHERE a.plan IN {in_list(plans)}),
prev AS (SELECT party_id, strftime(CAST(startdate AS DATE) + INTERVAL 12 MONTH, '%Y-%m-%d') AS startdate,
                a_to_e_value AS y_prior, state FROM aes),
state_mean AS (SELECT state, startdate, avg(y_prior) AS state_prior FROM prev GROUP BY ALL),
pairs AS (
  SELECT c.party_id, c.startdate, {fold_expr("c.startdate", starts)} AS fold, c.plan, c.state,
         c.a_to_e_value AS y_test, p.y_prior,
         0.5 * p.y_prior + 0.5 * sm.state_prior AS y_blend
  FROM aes c JOIN prev p ON p.party_id = c.party_id AND p.startdate = c.startdate
  JOIN state_mean sm ON sm.state = c.state AND sm.startdate = c.startdate
  WHERE c.startdate IN {in_list(starts)})"""


def edges(num: int = 300, start: float = 0.0, stop: float = 2.0) -> str:
    step = f"(({stop!r})::DOUBLE - ({start!r})::DOUBLE) / {float(num - 1)!r}::DOUBLE"
    return f"""edges AS (
  SELECT CAST(i AS INTEGER) AS i,
         CASE WHEN i = {num - 1} THEN ({stop!r})::DOUBLE ELSE i::DOUBLE * {step} + ({start!r})::DOUBLE END AS threshold
  FROM range({num}) r(i))"""


def curve_select(long_cte: str) -> str:
    """Theta-join form of the threshold curve over ``{long_cte}(score_name, s, m)``."""
    return f"""tot AS (SELECT score_name, count(*) AS total FROM {long_cte} GROUP BY 1)
SELECT t.score_name, e.i, round(e.threshold, 6) AS threshold,
       CAST(count(l.s) AS BIGINT) AS accepted,
       round(count(l.s) / t.total * 100.0, 6) AS accept_pct,
       round(avg(l.m), 6) AS mean_measure
FROM tot t CROSS JOIN edges e
LEFT JOIN {long_cte} l ON l.score_name = t.score_name AND l.s < e.threshold
GROUP BY t.score_name, e.i, e.threshold, t.total"""


def _window_sums(value: str, alias: str, windows=(3, 6, 12)) -> str:
    return ", ".join(
        f"sum(CASE WHEN l.odate >= s.startdate - INTERVAL {m} MONTH THEN {value} ELSE 0 END) AS {alias}_{m}mos"
        for m in windows)


def lookback_join(starts: Sequence[str] = START_DATES, span: int = 12) -> str:
    return (f"JOIN {starts_values(starts)} ON l.odate >= s.startdate - INTERVAL {span} MONTH "
            f"AND l.odate < s.startdate")


def icd_long(starts: Sequence[str] = START_DATES) -> str:
    return f"""icd AS (
  SELECT l.party_id, strftime(s.startdate, '%Y-%m-%d') AS startdate, l.p_type AS cat,
         {_window_sums("l.revenue", "ccsr")}
  FROM lines l {lookback_join(starts)}
  GROUP BY ALL)"""


def cpt_lines(starts: Sequence[str] = START_DATES) -> str:
    return f"""cptl AS (
  SELECT l.party_id, s.startdate AS sdate, strftime(s.startdate, '%Y-%m-%d') AS startdate, l.odate,
         l.p_brand AS ccs,
         CASE WHEN l.l_returnflag = 'R' THEN lpad(CAST(l.p_size AS VARCHAR), 3, '0') END AS drg,
         l.l_quantity
  FROM lines l {lookback_join(starts)})"""


CPT_LONG = """cpt AS (
  SELECT party_id, startdate, ccs AS cat,
         sum(CASE WHEN odate >= sdate - INTERVAL 3 MONTH THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ccs_3mos,
         sum(CASE WHEN odate >= sdate - INTERVAL 6 MONTH THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ccs_6mos,
         sum(1.0::DOUBLE) AS ccs_12mos
  FROM cptl WHERE ccs IS NOT NULL GROUP BY ALL)"""

DRG_LONG = """drg AS (
  SELECT party_id, startdate, drg AS cat, sum(l_quantity) AS drg_los
  FROM cptl WHERE drg IS NOT NULL GROUP BY ALL)"""


def block_long(name: str, src: str, domain_sql: str, values: Sequence[str]) -> str:
    """Long form of a fixed-domain pivot: every (key with rows) x (value, category)
    cell, 0 where the pair is absent; feature names ``{value}_{category}`` lower-case."""
    vals = " UNION ALL ".join(f"SELECT '{v}' AS v" for v in values)
    sums = " ".join(f"WHEN '{v}' THEN b.{v}" for v in values)
    return f"""{name}_dom AS ({domain_sql}),
{name}_keys AS (SELECT DISTINCT party_id, startdate FROM {src} WHERE cat IN (SELECT cat FROM {name}_dom)),
{name}_vals AS ({vals}),
{name}_long AS (
  SELECT k.party_id, k.startdate, lower(v.v || '_' || d.cat) AS feature,
         coalesce(sum(CASE v.v {sums} END), 0.0::DOUBLE) AS value
  FROM {name}_keys k CROSS JOIN {name}_dom d CROSS JOIN {name}_vals v
  LEFT JOIN {src} b ON b.party_id = k.party_id AND b.startdate = k.startdate AND b.cat = d.cat
  GROUP BY ALL)"""


DOM_CCSR = "SELECT DISTINCT p_type AS cat FROM part UNION SELECT 'ZZZ'"
DOM_CCS = "SELECT DISTINCT p_brand AS cat FROM part UNION SELECT 'ZZZ'"
DOM_DRG = "SELECT DISTINCT lpad(CAST(p_size AS VARCHAR), 3, '0') AS cat FROM part UNION SELECT 'ZZZ'"


def indicators(starts: Sequence[str] = START_DATES) -> str:
    """Latest prior-window order attributes and order counts per (member, start)."""
    return f"""ind_base AS (
  SELECT o.o_custkey AS party_id, o.o_orderkey, o.o_orderdate, CAST(o.o_orderdate AS DATE) AS odate,
         o.o_orderpriority, o.o_orderstatus, s.startdate AS sdate, strftime(s.startdate, '%Y-%m-%d') AS startdate
  FROM orders o JOIN {starts_values(starts)}
    ON CAST(o.o_orderdate AS DATE) >= s.startdate - INTERVAL 12 MONTH AND CAST(o.o_orderdate AS DATE) < s.startdate),
ind_latest AS (
  SELECT party_id, startdate, o_orderpriority AS marketing_channel, o_orderstatus AS tobacco_usage_ind
  FROM ind_base
  QUALIFY row_number() OVER (PARTITION BY party_id, startdate ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
ind_counts AS (
  SELECT party_id, startdate,
         CAST(sum(CASE WHEN odate >= sdate - INTERVAL 3 MONTH THEN 1 ELSE 0 END) AS BIGINT) AS claims_3mos,
         CAST(sum(CASE WHEN odate >= sdate - INTERVAL 6 MONTH THEN 1 ELSE 0 END) AS BIGINT) AS claims_6mos,
         CAST(count(*) AS BIGINT) AS claims_12mos
  FROM ind_base GROUP BY ALL),
ind AS (SELECT * FROM ind_latest JOIN ind_counts USING (party_id, startdate))"""


def blocks(starts: Sequence[str] = START_DATES) -> str:
    """The three pivot blocks in long form: icdp_long, drgp_long, cptp_long."""
    return f"""{icd_long(starts)},
{cpt_lines(starts)},
{CPT_LONG},
{DRG_LONG},
{block_long("icdp", "icd", DOM_CCSR, ["ccsr_3mos", "ccsr_6mos", "ccsr_12mos"])},
{block_long("drgp", "drg", DOM_DRG, ["drg_los"])},
{block_long("cptp", "cpt", DOM_CCS, ["ccs_3mos", "ccs_6mos", "ccs_12mos"])}"""


def panel_long(starts: Sequence[str] = START_DATES) -> str:
    """CTEs ending in ``panel_long``: the wide panel unpivoted over its feature
    columns (NULL where the member has no rows in a block)."""
    return f"""{LINES},
{MEMBERS},
{ae("ae", starts)},
{indicators(starts)},
{blocks(starts)},
feats AS (SELECT lower(v.v || '_' || d.cat) AS feature FROM icdp_dom d CROSS JOIN icdp_vals v
          UNION ALL SELECT lower(v.v || '_' || d.cat) FROM drgp_dom d CROSS JOIN drgp_vals v
          UNION ALL SELECT lower(v.v || '_' || d.cat) FROM cptp_dom d CROSS JOIN cptp_vals v),
blk AS (SELECT * FROM icdp_long UNION ALL SELECT * FROM drgp_long UNION ALL SELECT * FROM cptp_long),
pop AS (
  SELECT a.party_id, a.startdate, {fold_expr("a.startdate", starts)} AS fold, m.plan, m.state, m.zip, m.gender,
         i.marketing_channel, i.tobacco_usage_ind, i.claims_3mos, i.claims_6mos, i.claims_12mos,
         a.a_to_e_value
  FROM ae a JOIN members m USING (party_id)
  LEFT JOIN ind i ON i.party_id = a.party_id AND i.startdate = a.startdate),
panel_long AS (
  SELECT p.*, f.feature, b.value
  FROM pop p CROSS JOIN feats f
  LEFT JOIN blk b ON b.party_id = p.party_id AND b.startdate = p.startdate AND b.feature = f.feature)"""


def population(starts: Sequence[str] = START_DATES) -> str:
    """CTEs ending in ``pop``: one row per (member, start) with an outcome,
    member attributes and prior-window order indicators (no pivots)."""
    return f"""{LINES},
{MEMBERS},
{ae("ae", starts)},
{indicators(starts)},
pop AS (
  SELECT a.party_id, a.startdate, {fold_expr("a.startdate", starts)} AS fold, m.plan, m.state, m.zip, m.gender,
         i.marketing_channel, i.tobacco_usage_ind, i.claims_3mos, i.claims_6mos, i.claims_12mos,
         a.a_to_e_value
  FROM ae a JOIN members m USING (party_id)
  LEFT JOIN ind i ON i.party_id = a.party_id AND i.startdate = a.startdate)"""


SPARK_TYPE = ("CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
              "WHEN 'VARCHAR' THEN 'string' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' "
              "WHEN 'FLOAT' THEN 'float' ELSE lower({t}) END")


def band_case(expr: str, edges: Sequence[float], labels: Sequence[str], lower_open: bool = True) -> str:
    """SQL form of ``functions.binning.band``."""
    arms = []
    if lower_open:
        arms.append(f"WHEN {expr} < {float(edges[0])!r}::DOUBLE THEN '{labels[0]}'")
        for i in range(1, len(edges)):
            arms.append(f"WHEN {expr} < {float(edges[i])!r}::DOUBLE THEN '{labels[i]}'")
    else:
        for i in range(len(edges) - 1):
            arms.append(f"WHEN {expr} >= {float(edges[i])!r}::DOUBLE AND {expr} < {float(edges[i + 1])!r}::DOUBLE "
                        f"THEN '{labels[i]}'")
    return "CASE " + " ".join(arms) + f" ELSE '{labels[-1]}' END"
