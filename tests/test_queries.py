"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from nubla.plans.queries import QUERIES

CHECKED = ["full_redaction", "discarded", "detect_professional", "detect_date_partial", "detect_relative_age", "anonymised_table", "correspondence", "validate_summary", "column_profile", "relative_time", "email_documents", "clean_spaces", "highlighted_notes", "score_places", "transform_entity", "batch_summary", "accept_decisions", "profile_visits", "patient_column", "column_mapping", "entities_by_table", "gazetteer_cities", "dictionary_hits", "pdf_text", "workbook_roundtrip", "csv_roundtrip"]


def text(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(small):
    made = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        made.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return made


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, small, con, name):
    query, sql = QUERIES[name]
    assert text(query(spark, small).toPandas()) == text(con.execute(sql).df())


def test_every_query_has_sql():
    assert all(sql for _, sql in QUERIES.values())


def test_entry_without_llm(small):
    """The entry module registers the other queries where the training-data subpackage is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['nubla.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'full_redaction' in e.queries() and 'pipeline' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
