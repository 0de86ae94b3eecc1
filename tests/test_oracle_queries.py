"""A cross-section of registered queries against DuckDB on the smallest dataset."""
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tests.oracle import connection, rows

SAMPLE = (
    "src_05_order_item_scan", "src_09_lenient_json", "snk_03_feature_upsert", "prj_03_searchable_text", "flt_01_catalogue_filter", "dq_03_table_rules",
    "dq_05_event_validation", "agg_01_business_metrics", "agg_11_best_sellers", "agg_22_co_purchase_counts", "agg_25_serving_stats", "jn_08_impression_attribution",
    "topk_06_fallbacks", "pf_01_affinity", "pf_03_recent_lists", "pf_04_whole_profiles", "pf_05_whole_anonymous_profiles", "fs_01_user_features", "sg_01_rfm_frame", "rc_03_bm25_matrix", "rc_05_item_neighbours",
    "rc_09_co_purchase_graph", "rc_13_personal_scores", "sr_02_bm25", "sr_04_closest_terms", "sr_08_cosine_topk", "sr_18_search_modes", "ev_04_average_precision", "ev_10_psi", "mr_01_register",
    "scl_06_ngrams", "scl_11_percentiles", "st_03_live_funnel", "st_04_session_stream", "st_05_cart_state", "st_08_late_rows",
    "job_01_dashboard", "job_02_product_analytics", "ev_06_coverage_of_own_lists", "rc_17_bought_together_fallback", "srt_02_search_sorts",
)


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
