"""Rows on which doubles, or an order left open, would decide: the query and its SQL say the same."""

import duckdb
import pytest

from compare import assert_same
from gridlens.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """``check(name, recordings)``: a query against its SQL over recordings of (value, k, type) samples."""

    def check(name, recordings):
        rows = [(n, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rid, t, float(v), f'{{"k": {k}}}') for n, (rid, i, (v, k, t)) in enumerate((rid, i, s) for rid, r in enumerate(recordings) for i, s in enumerate(r))]
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "ts::timestamp_ntz AS ts", "user_id", "event_type", "value", "props")
        df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        assert_same(got, con, catalog.SQL[name])
        return got.collect()

    return check


def test_the_sharpest_change_is_the_largest_double(both):
    # Steps of 10.1 as doubles 10.099999999999998 and 10.100000000000001: the later one is larger.
    assert 30.2 - 20.1 < 45.1 - 35.0
    values = [20.1, 30.2, 35.0, 35.0, 45.1, 45.1, 45.1, 45.1, 45.1, 45.1]
    both("e8_step_features", [[(v, 50, "a") for v in values] for _ in range(2)])


def test_missed_families_are_in_order(both):
    pairs = [("signup", "error"), ("error", "signup"), ("purchase", "error"), ("error", "purchase"), ("view", "click"), ("click", "view")]
    rows = both("h5_set_accuracy", [[(10, 50, a) for a in two] + [(90, 50, "other")] * 30 for two in pairs])
    assert all(r["missed"].split(",") == sorted(r["missed"].split(",")) for r in rows)


def test_steps_of_just_the_least_power_are_edges(both):
    """Steps of 8 W and spreads of 6 W, which doubles miss by their noise, and five samples a second."""
    levels = [(a, round(a + 8.0, 2)) for a in (20.1, 33.3, 40.07, 57.29)]
    recordings = [[(a, 50, "x")] * 4 + [(b, 50, "x")] * 4 for a, b in levels] + [[(a, 50, "x"), (round(a + 12, 2), 50, "x")] * 2 + [(a + 80, 50, "x")] * 4 for a in (1.1, 3.3, 7.07, 10.29)]
    assert {r["rid"] for r in both("j1_edges", recordings)} == set(range(8))


def test_confidence_rounds_half_up_on_the_decimal(both):
    """A lamp of 40 W, 0 var, met at 40 W and so many tenths: its distance ends in a 5."""
    both("j4_matched_edges", [[(0, 50, "x")] * 4 + [(40 + k / 10, 50, "x")] * 4 for k in range(-99, 100, 2)])


def test_claims_of_five_samples_a_second_age_by_samples():
    from gridlens.operators.events import Claims

    assert 41 / 5 - 11 / 5 < 6
    c = Claims(hold=75, settle=30)
    c.edge(11, 100.0, "a", 0.9)
    assert c.guard(41, 0.0) == ["a"]
