"""Every registered analytics query runs on the small tables and agrees with its DuckDB counterpart."""

import pandas as pd
import pytest

from trackloom.plans import registry

Q, O = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't say, and the test that compares each with brute force or another arithmetic.
CHECKED = {
    "dedupe_leaders": "test_leaders_equal_a_greedy_pass", "dedupe_same_stories": "test_same_stories_equal_a_greedy_pass", "place_reconcile": "test_verdicts_by_hand",
    "fn_terminator": "test_terminator_and_sun_times_lie_on_their_threshold", "fn_sun_times": "test_terminator_and_sun_times_lie_on_their_threshold", "orbit_track": "test_tracks_and_passes_equal_another_propagation",
    "orbit_passes": "test_tracks_and_passes_equal_another_propagation", "reach_contours": "test_contours_equal_scalar_arithmetic_and_stop_at_land", "roll_interference": "test_roll_interference_query", "scan_jam_centres": "test_centres_of_landed_cells",
}


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        ok = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert ok.all(), (c, a[c][~ok].head(3).tolist(), b[c][~ok].head(3).tolist())


@pytest.mark.parametrize("name", list(O))
def test_query(spark, small, tables, name):
    got = Q[name](spark, small)
    assert len(set(got.columns)) == len(got.columns)
    same(got.toPandas(), tables.sql(O[name]).df())


def test_every_other_query_has_a_test_of_its_own():
    from tests import test_checks, test_rolling

    assert set(Q) - set(O) == set(CHECKED) and all(hasattr(test_checks, t) or hasattr(test_rolling, t) for t in CHECKED.values())


def test_flagship_is_registered():
    assert registry.FLAGSHIP in Q and set(O) <= set(Q)
