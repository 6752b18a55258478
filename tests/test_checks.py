"""Every family of queries against its SQL; SQUALL_ALL=1 runs all of them."""

import os

import pytest

from compare import connect, rows
from squallbars.catalog import CHECKS, QUERIES

SAMPLE = [
    "flagship_bar_features", "i02_atr", "i09_zscore_atr", "i17_adx", "w10_smart_lags", "w12_before_after", "i04_daily_block",
    "j06_daily_onto_hourly", "t04_future_efficiency", "t07_volatility_grade", "t09_direction_changes", "t10_swing_failure",
    "t18_set_targets", "t22_future_chaos", "x01_classify_source", "x09_specific_event", "x11_one_hot", "x13_economic_value",
    "x16_ngrams", "d02_nearest_slot", "d06_local_hour", "a02_main_event", "a03_one_hot_sums", "a05_rich_buckets",
    "a12_events_per_hour", "a18_describe", "a21_paired_test", "a22_pairwise_tests", "w03_neighbour_buckets",
    "w05_hours_since_key_event", "w07_lagged_target_stats", "w09_lagged_by_event_and_overall", "j01_bars_with_events",
    "j04_latest_with_next_bucket", "j07_asof_join", "j07_indicator_asof", "l15_update_ranges", "v01_quarter_blocks",
    "v05_rolling_windows", "m03_ordinal_gradation", "m05_interval_metrics", "m08_ranking_areas", "m09_best_thresholds",
    "m11_isotonic_calibration", "m12_calibration_curve", "s01_comma_bars", "s08_upsert_prices", "s11_newer_than_stored",
    "l09_alerts", "l12_daily_digests", "l14_settings_upsert_toggle", "s10_upsert_ranges", "v02_last_quarters",
    "v06_expanding_quarters", "v07_sequential_splits", "m13_fold_report", "x11_sparse_codes", "i24_exploratory_block", "i27_hurst",
    "i23_daily_features", "w07_known_range_history", "l06_live_rows",
    "st1_streamed_bars", "st2_streamed_events", "st3_streamed_alerts",
]
NAMES = sorted(CHECKS) if os.environ.get("SQUALL_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
