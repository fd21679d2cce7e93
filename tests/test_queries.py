"""Registered queries against their SQL. All of them with GLEANER_ALL=1, else one or two per area."""

import os

import pytest

from gleaner.plans.catalog import ORACLES, QUERIES
from gleaner.plans.check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["url_canonical", "page_clean", "lang_id", "parse_llm_json", "dedup_content_1day", "dedup_batch", "near_dup_pairs", "kw_search", "hybrid_search",
        "topic_aggregate", "relation_upsert", "related_merge", "wiki_article", "report_weekly", "job_outcome", "upsert_latest", "src_feed_xml", "st_dedup"]
NAMES = list(QUERIES) if os.environ.get("GLEANER_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert result["ok"], result
    assert "types" not in result, result


def test_every_query_but_model_vectors_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"text_vectors"}
