"""The risk panel over the driver's star-schema tables (FIXTURES.md section 3).

Mapping (member / claim / outcome -> test tables):

* member ``party_id``           -> ``c_custkey`` (= ``o_custkey``)
* ``plan``                      -> ``c_mktsegment``; kept plans are three segments
* ``state`` / ``zip``           -> ``r_name`` / ``c_nationkey``
* ``gender``                    -> ``c_custkey % 2`` ('F' even, 'M' odd)
* indicators                    -> priority and status of the member's latest
                                   order in the 12 months before the start date
* diagnosis category (CCSR)     -> ``p_type``; 3/6/12-month revenue sums
* procedure code (CCS)          -> ``p_brand``; 3/6/12-month line counts
* DRG and length of stay        -> ``lpad(p_size, 3, '0')`` on returned lines, Σ quantity
* actual                        -> revenue in the 12 months from the start date
* expected                      -> mean actual of the member's plan and start date
                                   (assumption: the real A/E formula is not published)

Everything is one lazy plan per call; the large inputs are ``lineitem`` and
``orders``, joined once on ``l_orderkey``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from riskpanel.operators.panel import lookback, pivot_features

# --- Fixed values of the proxy mapping --------------------------------------
START_DATES = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01"]  # folds 1-5
PRIOR_START = "1995-01-01"
KEPT_PLANS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
UNUSED_CATEGORY = "ZZZ"
WINDOWS = (3, 6, 12)
# -----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(startdate_col: str = "startdate", starts: Sequence[str] = START_DATES):
    """fold number = 1-based position of the start date in the sorted schedule."""
    arr = F.array(*[F.lit(s) for s in sorted(starts)])
    return F.array_position(arr, F.col(startdate_col)).cast("int")


def window_bounds(starts: Sequence[str], months: int, back: bool = True, fwd: bool = True):
    """Filter on the raw order date that holds every window of ``starts``: a plain range of
    literals, so it reaches the Parquet scan of ``orders``."""
    first, last = dt.datetime.fromisoformat(min(starts)), dt.datetime.fromisoformat(max(starts))

    def moved(d: dt.datetime, n: int) -> dt.datetime:
        y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
        return d.replace(year=y, month=m + 1, day=1)

    lo = moved(first, -months) if back else first
    hi = moved(last, months + 1) if fwd else last  # a month more: the window's exact end is checked per row
    return (F.col("o_orderdate") >= F.lit(lo)) & (F.col("o_orderdate") < F.lit(hi))


def claim_lines(spark: SparkSession, sf_dir: str, dates=None) -> DataFrame:
    """Dated claim lines: one row per line item with its member and codes. ``dates``: filter on
    the order date, applied to the scan of ``orders`` before any join."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag",
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("revenue"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o if dates is None else o.where(dates)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("o_custkey").alias("party_id"), "o_orderdate", "revenue",
                      "l_quantity", "l_returnflag", "p_type", "p_brand", "p_size"))


def code_items(domains: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(family, lower-case code) of every code of the domains; a code's place here plus 1 is its item number (0 is the outcome)."""
    families = (("ccsr", "CCSR_CATEGORY"), ("drg", "DRG"), ("ccs", "CCS"))
    return [(fam, c) for fam, kind in families for c in dict.fromkeys(d.lower() for d in domains[kind])]


def tagged_items(spark: SparkSession, sf_dir: str, starts: Sequence[str], domains: dict[str, list[str]],
                 windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Items of the claim lines ``(party_id, sdate, item, v3, v6, v12)``: a line gives its diagnosis, procedure and DRG to every start
    date whose look-back window (the 12 months before) holds it, and item 0 (its revenue) to those whose outcome window does.

    Codes turn into item numbers on the code table, so joins, shuffles and aggregates carry numbers of fixed width. A line lands
    in at most a handful of start dates; the candidates are a fixed list of CASE expressions, which stays in generated code.
    """
    numbers = {pair: i for i, pair in enumerate(code_items(domains), start=1)}
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("__ccsr"), F.col("p_brand").alias("__ccs"),
                                            F.lpad(F.col("p_size").cast("string"), 3, "0").alias("__drg"))
    for fam, kind in (("ccsr", "CCSR_CATEGORY"), ("ccs", "CCS"), ("drg", "DRG")):
        codes = spark.createDataFrame([(c, numbers[fam, c.lower()]) for c in domains[kind]], f"__{fam} string, {fam} int")
        p = p.join(F.broadcast(codes), f"__{fam}", "left").drop(f"__{fam}")  # the domains are schema-sized
    span = max(windows)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("revenue"))
    o = table(spark, sf_dir, "orders").where(window_bounds(starts, span)).select(
        "o_orderkey", F.col("o_custkey").alias("party_id"), F.to_date("o_orderdate").alias("d"))
    d, cands = F.col("d"), []
    for x in sorted(starts):
        s = F.to_date(F.lit(x))
        cands += [F.when((d >= F.add_months(s, -span)) & (d < s), F.struct(s.alias("sdate"), F.lit(True).alias("back"))),
                  F.when((d >= s) & (d < F.add_months(s, span)), F.struct(s.alias("sdate"), F.lit(False).alias("back")))]
    # the join with the orders comes last, in tasks of a fixed number of lines: they also sum the items before the shuffle
    coded = li.join(p, li.l_partkey == p.p_partkey).repartition(store_tasks(spark, sf_dir), "l_orderkey")
    lines = coded.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    t = lines.select("party_id", "d", "revenue", "l_quantity", "ccsr", "ccs", F.when(F.col("returned"), F.col("drg")).alias("drg"),
                     F.explode(F.array(*cands)).alias("__t")).where(F.col("__t").isNotNull())
    t = t.select("*", F.col("__t.sdate").alias("sdate"), F.col("__t.back").alias("back"))
    zero, one, rev = F.lit(0.0), F.lit(1.0), F.col("revenue").cast("double")
    w3, w6 = (d >= F.add_months(F.col("sdate"), -m) for m in windows if m != span)

    def item(number, v3, v6, v12):
        return F.struct(number.alias("item"), v3.alias("v3"), v6.alias("v6"), v12.cast("double").alias("v12"))

    back = F.array(item(F.col("ccsr"), F.when(w3, rev).otherwise(zero), F.when(w6, rev).otherwise(zero), rev),
                   item(F.col("ccs"), F.when(w3, one).otherwise(zero), F.when(w6, one).otherwise(zero), one),
                   item(F.col("drg"), zero, zero, F.col("l_quantity")))
    fwd = F.array(item(F.lit(0), zero, zero, rev))
    return t.select("party_id", "sdate", F.explode(F.when(F.col("back"), back).otherwise(fwd)).alias("i")) \
            .select("party_id", "sdate", "i.*").where(F.col("item").isNotNull())


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static member attributes (customer ⋈ nation ⋈ region). The two dimension
    tables carry no hint: Spark broadcasts them from their file-size statistics
    (``autoBroadcastJoinThreshold``), which is the size check."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("c_custkey").alias("party_id"), F.col("c_mktsegment").alias("plan"),
                     F.col("r_name").alias("state"), F.col("c_nationkey").cast("string").alias("zip"),
                     F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
                     F.col("c_acctbal")))


def a_to_e(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES) -> DataFrame:
    """Outcome per (member, start date): actual revenue in the next 12 months,
    expected = mean actual over the same plan and start date, and their ratio.

    The plan mean is a grouped aggregate joined back (plans x start dates rows),
    not a window over a whole plan; no size check job is spent on it, AQE
    broadcasts it from the runtime size of its shuffle stage.
    """
    lines = claim_lines(spark, sf_dir, window_bounds(starts, 12, back=False)).select("party_id", "o_orderdate", "revenue")
    fwd = lookback(lines, "o_orderdate", starts, [12], {"revenue": F.col("revenue")}, forward=True)
    actual = fwd.groupBy("party_id", "startdate").agg(F.sum("revenue").alias("actual"))
    m = members(spark, sf_dir).select("party_id", "plan")
    # the plan means are joined back onto the same rows, and most callers
    # branch further: write the per-member actuals once so no branch
    # re-reads the claim lines (filters pushed into one branch only would
    # otherwise defeat shuffle reuse)
    from riskpanel.session import materialize
    a = materialize(actual.join(m, "party_id"), "actuals")
    # plans x start dates rows: AQE sees the materialised size and broadcasts it
    exp = a.groupBy("plan", "startdate").agg(F.avg("actual").alias("expected"))
    return (a.join(exp, ["plan", "startdate"])
             .select("party_id", "startdate", "plan", "actual", "expected",
                     F.try_divide("actual", "expected").alias("a_to_e_value")))


def diagnosis_long(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES) -> DataFrame:
    """ICD-like long table: (party_id, startdate, CCSR_CATEGORY, CCSR_3mos/6mos/12mos)."""
    lines = claim_lines(spark, sf_dir, window_bounds(starts, max(WINDOWS), fwd=False)).select(
        "party_id", "o_orderdate", "revenue", "p_type")
    lb = lookback(lines, "o_orderdate", starts, WINDOWS, {"CCSR": F.col("revenue")})
    return (lb.groupBy("party_id", "startdate", F.col("p_type").alias("CCSR_CATEGORY"))
              .agg(*[F.sum(f"CCSR_{m}mos").alias(f"CCSR_{m}mos") for m in WINDOWS]))


def procedure_long(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES) -> DataFrame:
    """CPT-like line table: (party_id, startdate, CCS, CCS_3mos/6mos/12mos, DRG, DRG_LoS)."""
    lines = claim_lines(spark, sf_dir, window_bounds(starts, max(WINDOWS), fwd=False)).select(
        "party_id", "o_orderdate", F.col("p_brand").alias("CCS"),
        F.when(F.col("l_returnflag") == "R", F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("DRG"),
        "l_quantity")
    lb = lookback(lines, "o_orderdate", starts, WINDOWS, {"CCS": F.lit(1.0)})
    return lb.select("party_id", "startdate", "CCS", *[f"CCS_{m}mos" for m in WINDOWS], "DRG",
                     F.col("l_quantity").alias("DRG_LoS"))


def code_domains(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Category domains from the code table (``part``), each with one unused code.

    One distinct over (kind, code) pairs: the domains become output columns, so
    they are schema metadata on the driver.
    """
    p = table(spark, sf_dir, "part")
    kinds = {"CCSR_CATEGORY": F.col("p_type"), "CCS": F.col("p_brand"),
             "DRG": F.lpad(F.col("p_size").cast("string"), 3, "0")}
    pairs = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
                                         for k, v in kinds.items()])).alias("x")).select("x.*")
    rows = pairs.where(F.col("v").isNotNull()).distinct().collect()
    return {k: sorted({r.v for r in rows if r.k == k} | {UNUSED_CATEGORY}) for k in kinds}


def pivots(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES,
           domains: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """A1 three times: diagnosis sums, DRG length of stay, procedure counts."""
    domains = domains or code_domains(spark, sf_dir)
    keys = ["party_id", "startdate"]
    icd = diagnosis_long(spark, sf_dir, starts)
    cpt = procedure_long(spark, sf_dir, starts)
    return {
        "icd": pivot_features(icd, keys, "CCSR_CATEGORY", [f"CCSR_{m}mos" for m in WINDOWS],
                              domains["CCSR_CATEGORY"]),
        "drg": pivot_features(cpt.where(F.col("DRG").isNotNull()), keys, "DRG", ["DRG_LoS"], domains["DRG"]),
        "cpt": pivot_features(cpt.where(F.col("CCS").isNotNull()), keys, "CCS",
                              [f"CCS_{m}mos" for m in WINDOWS], domains["CCS"]),
    }


def order_indicators(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES) -> DataFrame:
    """Per (member, start): latest prior-year order's priority and status (W1, as a
    ``max_by`` over (date, key)) and order counts in the 3/6/12-month windows,
    all in one partial aggregate over the orders of the look-back windows."""
    o = table(spark, sf_dir, "orders").where(window_bounds(starts, max(WINDOWS), fwd=False)).select(
        F.col("o_custkey").alias("party_id"), "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lb = lookback(o, "o_orderdate", starts, WINDOWS, {"claims": F.lit(1)})
    latest = F.max_by(F.struct("o_orderpriority", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    agg = lb.groupBy("party_id", "startdate").agg(
        latest.alias("__l"), *[F.sum(f"claims_{m}mos").cast("long").alias(f"claims_{m}mos") for m in WINDOWS])
    return agg.select("party_id", "startdate", F.col("__l.o_orderpriority").alias("marketing_channel"),
                      F.col("__l.o_orderstatus").alias("tobacco_usage_ind"),
                      *[f"claims_{m}mos" for m in WINDOWS])


def policies(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES) -> DataFrame:
    """Members with an outcome per start date, their attributes and prior-window
    order indicators (the panel without its claim pivots)."""
    ae = a_to_e(spark, sf_dir, starts).select("party_id", "startdate", "a_to_e_value")
    return (ae.join(members(spark, sf_dir).drop("c_acctbal"), "party_id")
              .join(order_indicators(spark, sf_dir, starts), ["party_id", "startdate"], "left")
              .select("party_id", "startdate", fold_of("startdate", starts).alias("fold"), "plan", "state", "zip",
                      "gender", "marketing_channel", "tobacco_usage_ind", "claims_3mos", "claims_6mos",
                      "claims_12mos", "a_to_e_value"))


def _with_outcome(spark: SparkSession, sf_dir: str, agg: DataFrame, starts: Sequence[str]) -> DataFrame:
    """Rows with an outcome -> member attributes, expected (plan mean) and A/E."""
    a = agg.join(members(spark, sf_dir).drop("c_acctbal"), "party_id")
    exp = a.groupBy("plan", "startdate").agg(F.avg("actual").alias("expected"))
    return (a.join(exp, ["plan", "startdate"])
             .withColumn("a_to_e_value", F.try_divide("actual", "expected"))
             .withColumn("fold", fold_of("startdate", starts)))


def panel(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES,
          domains: dict[str, list[str]] | None = None) -> DataFrame:
    """The wide training panel, one row per (member, start date) with an outcome.

    Same result as ``policies ⟕ icd ⟕ drg ⟕ cpt ⋈ a_to_e``, but the claim lines
    are read once, into the long store; the store is pivoted to wide at member
    level. A member without claims of a block gets NULL for the whole block
    (the left-join result): the store keeps every 12-month cell of a claimed
    code, so "any 12-month cell present" is the block's presence test. Only the
    order indicators read ``orders`` again.
    """
    domains = domains or code_domains(spark, sf_dir)
    out = panel_values(spark, sf_dir, starts, domains)
    return out.select(*PANEL_ROW, *[F.col("values")[i].alias(n) for i, n in enumerate(feature_names(domains))], "a_to_e_value", "fold")


PANEL_ROW = ["party_id", "startdate", "plan", "state", "zip", "gender", "marketing_channel", "tobacco_usage_ind",
             *[f"claims_{m}mos" for m in WINDOWS]]


def panel_values(spark: SparkSession, sf_dir: str, starts: Sequence[str], domains: dict[str, list[str]]) -> DataFrame:
    """The rows of :func:`panel` with their features as one array ``values``, in the order of :func:`feature_names`."""
    keys = ["party_id", "startdate"]
    store = member_store(spark, sf_dir, starts, domains)
    numbers = {pair: i for i, pair in enumerate(code_items(domains), start=1)}
    at = {v: np.full(len(numbers) + 1, -1) for v in ("v3", "v6", "v12")}  # by item number: where its amount goes
    families = {f: [] for f in ("ccsr", "drg", "ccs")}
    for i, name in enumerate(feature_names(domains)):
        fam, window, code = name.split("_", 2)
        at[{"3mos": "v3", "6mos": "v6"}.get(window, "v12")][numbers[fam, code]] = i
        families[fam].append(i)
    # the outcome rows come from the same store; a row's few entries are spread over its array last
    out = outcome_rows(spark, sf_dir, store, starts).join(order_indicators(spark, sf_dir, starts), keys, "left") \
        .join(store.where("has_actual").drop("has_actual", "actual"), keys, "left")
    out = out.select(*PANEL_ROW, "a_to_e_value", "fold", "has_ccsr", "has_drg", "has_ccs", "items")
    schema = StructType([*out.schema.fields[:-4], StructField("values", ArrayType(DoubleType()))])
    return out.mapInArrow(spreader(at, families, sum(map(len, families.values()))), schema)


def spreader(at: dict[str, np.ndarray], families: dict[str, list[int]], size: int, most: int = 4_000_000):
    """Rows with ``items`` and ``has_*`` marks -> the same rows with the dense array ``values``: amount ``v`` of an item goes to place ``at[v][item]``,
    the other places are 0, those of a family that a row doesn't have are NULL. At most ``most`` places are made at a time."""
    def spread(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for whole in batches:
            step = max(most // max(size, 1), 1)
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                n, items = batch.num_rows, batch.column("items")
                count = np.asarray(pc.fill_null(pc.list_value_length(items), 0))
                flat, row = items.flatten(), np.repeat(np.arange(n), count)
                item = np.asarray(flat.field("item"))
                dense, none = np.zeros((n, size)), np.zeros((n, size), bool)
                for v, place in at.items():
                    amount = np.asarray(pc.fill_null(flat.field(v), 0.0))
                    to = place[item]
                    dense[row[to >= 0], to[to >= 0]] = amount[to >= 0]
                for fam, places in families.items():
                    has = np.asarray(pc.fill_null(batch.column(f"has_{fam}"), False))
                    none[np.ix_(~has, places)] = True
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(dense.ravel(), mask=none.ravel()))
                keep = [c for c in batch.schema.names if c != "items" and c not in {f"has_{f}" for f in families}]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], values], names=[*keep, "values"])
    return spread


def panel_profile(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Counts of every claim feature of the panel (and group), from the store."""
    from riskpanel.operators.store import feature_profile
    domains = code_domains(spark, sf_dir)
    long, rows = claims_store(spark, sf_dir, domains=domains)
    names = spark.createDataFrame([(n,) for n in feature_names(domains)], "feature string")
    keys = ["party_id", "startdate"]
    rows = rows.select(*keys, *([by] if by else []))
    return feature_profile(long.where(F.col("feature") != "__actual"), rows, keys, names, by)


def claims_store(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES,
                 domains: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The long feature store and the outcome rows from ONE pass over the claim lines.

    Returns ``(long, rows)``. ``long(party_id, startdate, feature, value)``
    holds every 12-month cell of a claimed code and the non-zero 3/6-month
    cells (zeros implicit), plus one ``__actual`` entry per outcome;
    ``rows`` has one row per (member, start) with an outcome, its attributes,
    ``a_to_e_value`` and ``fold``. Both read the same :func:`member_store`.
    """
    domains = domains or code_domains(spark, sf_dir)
    store = member_store(spark, sf_dir, starts, domains)
    return store_long(store, domains), outcome_rows(spark, sf_dir, store, starts)


#: Claim lines that one task of the store gathers: their number fixes the number of tasks, so a task keeps its size on larger tables.
STORE_LINES = 500_000


def member_store(spark: SparkSession, sf_dir: str, starts: Sequence[str], domains: dict[str, list[str]]) -> DataFrame:
    """One row per (member, start date) with claims, written once to the shared checkpoint folder.

    ``items`` lists the claimed codes (``item``, see :func:`code_items`) with their 3/6/12-month amounts; ``has_actual`` and ``actual``
    are the outcome, ``has_ccsr``, ``has_drg`` and ``has_ccs`` tell whether a 12-month amount of the family is there. Lines
    are summed by code first (partially before the shuffle, so a hot member is combined there); a row lists each code once.
    """
    from riskpanel.session import materialize
    agg = tagged_items(spark, sf_dir, starts, domains).groupBy("party_id", "sdate", "item").agg(
        *[F.sum(v).alias(v) for v in ("v3", "v6", "v12")])
    item, first, has = F.col("item"), 1, []
    for fam in ("ccsr", "drg", "ccs"):
        last = first + sum(f == fam for f, _ in code_items(domains))
        has.append(F.max((item >= first) & (item < last) & F.col("v12").isNotNull()).alias(f"has_{fam}"))
        first = last
    rows = agg.repartition(store_tasks(spark, sf_dir), "party_id", "sdate").groupBy("party_id", "sdate").agg(
        F.collect_list(F.when(item > 0, F.struct("item", "v3", "v6", "v12"))).alias("items"),
        F.max(item == 0).alias("has_actual"), F.max(F.when(item == 0, F.col("v12"))).alias("actual"), *has)
    return materialize(rows.select("party_id", F.date_format("sdate", "yyyy-MM-dd").alias("startdate"), *rows.columns[2:]), "claims_store")


def store_tasks(spark: SparkSession, sf_dir: str) -> int:
    return max(-(-table(spark, sf_dir, "lineitem").count() // STORE_LINES), 1)


def store_long(store: DataFrame, domains: dict[str, list[str]], carry: Sequence[str] = ()) -> DataFrame:
    """The long form of :func:`member_store`, see :func:`claims_store`; ``carry``: further columns of ``store`` to keep."""
    own = ["party_id", "startdate", *carry]
    names = item_names(domains)
    i = F.col("i.item")
    named = [F.element_at(F.array(*[F.lit(n[w]).cast("string") for n in names]), i) for w in range(3)]
    cells = F.array(*[F.struct(n.alias("feature"), F.col(f"i.{v}").alias("value"), F.lit(v == "v12").alias("whole"))
                      for n, v in zip(named, ("v3", "v6", "v12"))])
    long = store.select(*own, F.explode("items").alias("i")).select(*own, F.explode(cells).alias("x")).select(*own, "x.*") \
        .where(F.col("feature").isNotNull() & (F.col("whole") | (F.col("value") != 0))).drop("whole")
    return long.unionByName(store.where("has_actual").select(*own, F.lit("__actual").alias("feature"), F.col("actual").alias("value")))


def item_names(domains: dict[str, list[str]]) -> list[tuple[str | None, str | None, str]]:
    """Feature names of the items 1, 2, ... by window (3, 6 and 12 months; a DRG has one)."""
    return [(None, None, f"drg_los_{c}") if fam == "drg" else tuple(f"{fam}_{m}mos_{c}" for m in WINDOWS)
            for fam, c in code_items(domains)]


def outcome_rows(spark: SparkSession, sf_dir: str, store: DataFrame, starts: Sequence[str]) -> DataFrame:
    return _with_outcome(spark, sf_dir, store.where("has_actual").select("party_id", "startdate", "actual"), starts)


def score_pairs(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES,
                prior: str = PRIOR_START, plans: Sequence[str] | None = KEPT_PLANS) -> DataFrame:
    """Scored set: this year's A/E (``y_test``) against two scores built from the
    prior year: ``y_prior`` (prior A/E) and ``y_blend`` (half prior A/E, half the
    prior-year mean of the member's state). One row per member and start date
    with both years present; plans filtered with F1.
    """
    all_starts = sorted(set(starts) | {prior})
    ae = a_to_e(spark, sf_dir, all_starts)
    if plans is not None:
        ae = ae.where(F.col("plan").isin(list(plans)))
    m = members(spark, sf_dir).select("party_id", "state")
    ae = ae.join(m, "party_id")
    prev = ae.select("party_id", F.date_format(F.add_months(F.to_date("startdate"), 12), "yyyy-MM-dd")
                     .alias("startdate"), "state", F.col("a_to_e_value").alias("y_prior"))
    state_mean = prev.groupBy("state", "startdate").agg(F.avg("y_prior").alias("state_prior"))
    cur = ae.where(F.col("startdate").isin(list(starts))).select(
        "party_id", "startdate", "plan", "state", F.col("a_to_e_value").alias("y_test"))
    return (cur.join(prev.drop("state"), ["party_id", "startdate"])
               .join(state_mean, ["state", "startdate"])
               .select("party_id", "startdate", fold_of("startdate", starts).alias("fold"), "plan", "state",
                       "y_test", "y_prior",
                       (F.lit(0.5) * F.col("y_prior") + F.lit(0.5) * F.col("state_prior")).alias("y_blend")))


def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy underwriting score per member (``(acctbal + 1000) / 5000``), keyed
    by a differently named column, as the reference's legacy table is."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("legacy_party_id"),
                    ((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(5000.0)).alias("legacy_score"))


def feature_names(domains: dict[str, list[str]]) -> list[str]:
    """Wide feature names of the three pivots, in panel order."""
    from riskpanel.operators.panel import pivot_names
    names = []
    names += [n for _, _, n in pivot_names([f"CCSR_{m}mos" for m in WINDOWS], domains["CCSR_CATEGORY"])]
    names += [n for _, _, n in pivot_names(["DRG_LoS"], domains["DRG"])]
    names += [n for _, _, n in pivot_names([f"CCS_{m}mos" for m in WINDOWS], domains["CCS"])]
    return names

def training_frame(spark: SparkSession, sf_dir: str, starts: Sequence[str] = START_DATES) -> DataFrame:
    """The panel cleaned for modelling (kept plans, no zip / start date,
    text as categories, numerics filled with 0)."""
    from riskpanel.operators.cleaning import clean_fold
    return clean_fold(panel(spark, sf_dir, starts), KEPT_PLANS, drop=["zip", "startdate"])


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored set written once, for operators that make several passes over it
    (moments + quantile ranking, range + counts, iterative fits)."""
    from riskpanel.session import materialize
    return materialize(score_pairs(spark, sf_dir), "scored")
