"""The panel queries beside their SQL, on events whose prices are 0 or whose returns lie at a half of the last decimal."""

import math
import os
import sys
from datetime import datetime, timedelta

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.operators import panel
from tidemark.plans import studies

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def write(spark, folder, values):
    """Events of {(user, day): values in order}; values of a day are a minute apart."""
    rows, n = [], 0
    for (user, day), vs in values.items():
        for i, v in enumerate(vs):
            rows.append((n, T0 + timedelta(days=day, minutes=i), user, "view", v))
            n += 1
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return str(folder)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark, sf_dir, name, keys):
    """The query's rows by key, after a check that its SQL gives the same ones, infinity and NaN included."""
    df = studies.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    cur = con.execute(studies.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = {tuple(r[names.index(k)] for k in keys): dict(zip(names, r, strict=True)) for r in cur.fetchall()}
    got = {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
    assert got.keys() == want.keys()
    bad = [(k, c, got[k][c], want[k][c]) for k in want for c in names if not same(got[k][c], want[k][c])]
    assert bad == []
    return got


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """Forty users on six days; some prices are 0, one day's factor is of one value, one day has two users and one day one."""
    values = {}
    for day in range(6):
        for user in range(40):
            values[user, day] = [float((user * 37 + day * 11) % 50 + 1), float((user * 13 + day * 7) % 23 + 1)]
    values[3, 1] = [9.0, 0.0]
    values[4, 1] = [8.0, 0.0]
    values[4, 2] = [5.0, 0.0]
    for user in range(40):
        values[user, 3] = [6.0, 6.0]
    for day, most in ((6, 2), (7, 1), (8, 2), (9, 2)):
        for user in range(most):
            values[user, day] = [3.0 + user, 4.0 + 2 * user * day]
    return write(spark, tmp_path_factory.mktemp("zeros"), values)


def test_forward_returns_of_a_price_of_zero(spark, zeros):
    got = compare(spark, zeros, "panel_forward_returns", ("asset", "d"))
    assert got[3, 2]["fwd_1"] == math.inf and math.isnan(got[4, 2]["fwd_1"])


def test_forward_returns_at_a_half_of_the_last_decimal(spark, tmp_path):
    pairs = [(p, q) for q in (5120, 10240, 1024, 2048) for p in range(1, 9000, 10)]
    values = {(i, day): [price / 100] for i, (p, q) in enumerate(pairs) for day, price in ((0, q), (1, p))}
    compare(spark, write(spark, tmp_path, values), "panel_forward_returns", ("asset", "d"))


def test_the_operator_leaves_a_price_of_zero_without_a_return(spark):
    rows = spark.createDataFrame([(1, 7, 0.0), (2, 7, 3.0)], "d int, asset int, price double")
    assert [r.fwd_1 for r in panel.forward_returns(rows, (1,)).orderBy("d").collect()] == [None, None]
    assert [r.fwd_1 for r in panel.forward_returns(rows, (1,), ieee=True).orderBy("d").collect()] == [math.inf, None]


def test_coefficients_of_infinite_returns_and_without_variance(spark, zeros):
    got = compare(spark, zeros, "panel_information_coefficients", ("date",))
    assert got["2024-01-02",]["n"] == 40 and math.isnan(got["2024-01-02",]["ic"]) and got["2024-01-02",]["rank_ic"] is not None
    assert math.isnan(got["2024-01-04",]["ic"]) and got["2024-01-07",]["ic"] is None


def test_coefficients_of_one_value_are_missing_and_no_error(spark):
    rows = panel.dated(spark.createDataFrame([(T0.date(), a, 5.0, float(a)) for a in range(4)] + [(T0.date() + timedelta(days=1), a, 5.0, 1.0) for a in range(4)], "date date, asset int, factor double, fwd_1 double"))
    assert [(r.n, r.ic, r.rank_ic) for r in panel.information_coefficients(rows, "fwd_1").collect()] == [(4, None, None)] * 2
    assert [r.autocorrelation for r in panel.rank_autocorrelation(rows).collect()] == [None]


def test_summary_of_infinite_returns(spark, zeros):
    (row,) = compare(spark, zeros, "panel_ic_summary", ()).values()
    assert math.isnan(row["ic_mean"]) and row["ic_hit"] > 0


def test_summary_of_dates_of_two_rows(spark, tmp_path):
    """Both dates have the coefficient 1 or -1, so a deviation of 0 or not, and a third has none."""
    values = {(u, d): [v] for u, vs in enumerate(([1.0, 2.0, 3.0, 9.0], [2.0, 8.0, 4.0, 8.0])) for d, v in enumerate(vs)}
    compare(spark, write(spark, tmp_path, values), "panel_ic_summary", ())
    flat = {(u, d): [v] for u, vs in enumerate(([1.0, 2.0, 3.0], [2.0, 8.0, 24.0])) for d, v in enumerate(vs)}
    (row,) = compare(spark, write(spark, tmp_path, flat), "panel_ic_summary", ()).values()
    assert (row["ic_mean"], row["ic_std"], row["ic_ir"]) == (1.0, 0.0, math.inf)


def test_portfolio_of_infinite_returns_and_without_a_gross_sum(spark, zeros):
    got = compare(spark, zeros, "panel_portfolio", ("date",))
    assert not math.isfinite(got["2024-01-02",]["portfolio_return"])
    assert math.isnan(got["2024-01-08",]["portfolio_return"]) and got["2024-01-08",]["group_neutral_return"] == 0.0


def test_quantiles_of_infinite_returns(spark, zeros):
    got = compare(spark, zeros, "panel_quantile_returns", ("date", "quantile"))
    assert sum(r["n"] for k, r in got.items() if k[0] == "2024-01-02") == 40
