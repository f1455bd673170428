"""A few queries against their SQL counterparts on the smallest data; the rest by script."""

from pathlib import Path

import duckdb
import pytest

from check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = (
    "detect_ssn", "detect_iban", "detect_nl_bsn", "document_spans", "keyed_secrets",
    "announced_free_text", "code_filter", "summarize", "user_messages", "scrub_payload",
    "assembled_answers", "chunk_text", "reject_entity", "scrubbed_fields", "excluded_rows", "merge_overlap", "merge_best",
)


@pytest.fixture(scope="module")
def con():
    if not Path(SF).is_dir():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from maskwell.plans import catalog

    ok, note = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert ok, note


def test_names_agree():
    from maskwell.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    open_ended = set(catalog.queries()) - set(catalog.oracle_sql())
    assert open_ended == {
        "entities", "detect_mode_vote", "detect_mode_overlap",
        "detect_mode_exact", "detect_mode_best",
    }
