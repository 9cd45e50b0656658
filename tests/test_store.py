"""The member store and what reads it: the panel, the outcomes, the correlations and the training vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskpanel.ml import sparse
from riskpanel.operators import selection
from riskpanel.plans import proxy, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Member 1 has claims before and after 1997, member 2 only an outcome in 1997, member 3 no customer row."""
    d = str(tmp_path_factory.mktemp("tables"))
    day = lambda y, m: dt.datetime(y, m, 10)
    made = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(7, 0)], "n_nationkey int, n_regionkey int"),
        "customer": ([(1, "BUILDING", 7, 10.0), (2, "BUILDING", 7, 20.0)], "c_custkey bigint, c_mktsegment string, c_nationkey int, c_acctbal double"),
        "part": ([(1, "B#1", "TIN", 5), (2, "B#2", "ZINC", 6)], "p_partkey bigint, p_brand string, p_type string, p_size int"),
        "orders": ([(10, 1, "O", day(1996, 11), "1-URGENT"), (11, 1, "F", day(1997, 3), "2-HIGH"), (12, 2, "O", day(1997, 4), "2-HIGH"),
                    (13, 3, "O", day(1997, 4), "2-HIGH")],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(10, 1, 2.0, 100.0, 0.1, "R"), (10, 1, 3.0, 50.0, 0.0, "N"), (11, 2, 1.0, 30.0, 0.0, "N"), (12, 2, 1.0, 90.0, 0.0, "R"),
                      (13, 1, 1.0, 5.0, 0.0, "N")],
                     "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_panel_is_spread_from_one_row_a_member(spark, tables):
    """the wide panel needs no aggregate with a buffer per column; blocks without claims stay NULL."""
    domains = proxy.code_domains(spark, tables)
    wide = proxy.panel(spark, tables, domains=domains)
    assert "pivotfirst" not in wide._jdf.queryExecution().toString().lower()
    rows = {(r.party_id, r.startdate): r for r in wide.collect()}
    assert sorted(rows) == [(1, "1996-01-01"), (1, "1997-01-01"), (2, "1997-01-01")]
    r = rows[1, "1997-01-01"]
    assert (r["ccsr_3mos_tin"], r["ccsr_12mos_tin"], r["ccsr_12mos_zinc"], r["drg_los_005"], r["ccs_3mos_b#1"], r["ccs_12mos_zzz"]) \
        == (140.0, 140.0, 0.0, 2.0, 2.0, 0.0)
    assert rows[2, "1997-01-01"]["ccsr_12mos_tin"] is None and rows[1, "1996-01-01"]["drg_los_005"] is None
    long = queries.training_panel(spark, tables)
    assert "Expand" not in long._jdf.queryExecution().toString()
    assert long.count() == 3 * len(proxy.feature_names(domains))
    got = {(x.party_id, x.startdate, x.feature): x.value for x in long.collect()}
    assert all(got[k, s, n] == rows[k, s][n] for k, s in rows for n in proxy.feature_names(domains))


def test_outcomes_of_all_years_are_joined_once(spark, tables, monkeypatch):
    """the claim lines are joined for all years together."""
    from riskpanel import session
    labels, write = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, label="table": labels.append(label) or write(df, label))
    got = {(r.party_id, r.startdate): (r.actual, r.a_to_e_value) for r in queries.stacked_outcomes(spark, tables).collect()}
    assert labels == ["actuals"]
    assert got == {(1, "1996-01-01"): (140.0, 1.0), (1, "1997-01-01"): (None, 0.5), (2, "1997-01-01"): (None, 1.5)}


def test_cross_corr_writes_the_used_cells_once(spark, monkeypatch):
    """one shuffle gathers both families of a key, keys that are NULL pair with none."""
    labels, write = [], selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda df, label="table": labels.append(label) or write(df, label))
    cells = [(1, 1, "a_x", 2.0), (1, 1, "b_x", 4.0), (1, 2, "a_x", 3.0), (1, 2, "b_x", 6.0), (1, 3, "b_y", 1.0), (1, None, "a_x", 1.0), (1, None, "b_x", 2.0),
             (1, 4, "c_z", 9.0)]
    long = spark.createDataFrame(cells, "fold int, k int, feature string, value double")
    chosen = spark.createDataFrame([(1, "a_x")], "fold int, feature string")
    n = spark.createDataFrame([(1, 5)], "fold int, n long")
    out = {r.other: r["corr"] for r in selection.cross_corr_by(long, ["k"], "fold", chosen, "b_", ["b_x", "b_y"], n).collect()}
    assert labels.count("feature_cells") == 1
    # five rows; the cells of the key NULL count in the features' own moments, but not in their products
    sa, sb, qa, qb, ab = 6.0, 12.0, 14.0, 56.0, 26.0
    assert out["b_x"] == pytest.approx((ab / 5 - sa * sb / 25) / ((qa / 5 - (sa / 5) ** 2) * (qb / 5 - (sb / 5) ** 2)) ** 0.5)


def test_item_vectors_equal_those_of_single_cells(spark):
    """Vectors straight from a member's items, as from cells that are shuffled one by one."""
    rows = spark.createDataFrame([(1, 1.0, "u", 3.0), (2, 2.0, None, 0.0), (3, 3.0, "w", None)], "id int, y double, t string, x double")
    store = spark.createDataFrame([(1, [(2, 0.0, 5.0), (1, 7.0, 8.0)]), (2, [(1, None, 4.0)]), (9, [(1, 1.0, 1.0)])],
                                  "id int, items array<struct<item:int,v3:double,v12:double>>")
    names = [("p3", "p12"), (None, "q12")]
    cells = spark.createDataFrame([(1, "q12", 5.0), (1, "p3", 7.0), (1, "p12", 8.0), (2, "p12", 4.0)], "id int, feature string, value double")
    every = sparse.store_cells(cells, ["id"]).unionByName(sparse.row_cells(rows, ["id"], ["x"], ["t"]))
    index = sparse.feature_index(every.where("column <> 'q12'"))  # a feature that a model doesn't know
    want = {r.id: (r.y, r.vector) for r in sparse.vectors(rows.select("id", "y"), every, index, ["id"]).collect()}
    for few in (0, 100):
        got = sparse.item_vectors(rows, store, names, index, ["id"], ["x"], ["t"], ["y"], broadcast_rows=few)
        assert {r.id: (r.y, r.vector) for r in got.collect()} == want
    assert sum(len(v.indices) for _, v in want.values()) == 6 and got.where(F.col("id") == 9).count() == 0
