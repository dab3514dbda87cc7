"""Every registered query against its DuckDB oracle on the supplied tables (the driver's
correctness gate, run here on sf0.001 so the suite stays quick)."""

import re

import pytest

from checks.compare import compare, duck
from conftest import SF_SMALL

import __spark_entry__ as E

ORACLE = E.oracle_sql()
#: The optional subpackage's queries have tests of their own.
NAMES = sorted(n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    fn = E.queries()[name]
    if name in ORACLE:
        assert compare(spark, name, fn, ORACLE[name], SF_SMALL, con)
    else:
        df = fn(spark, SF_SMALL)
        assert df.count() >= 0 and len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["qid", "rank", "key", "reference", "book_name", "book_short", "chapter", "verse",
                          "title", "text", "version", "score", "reranked_score"]


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(NAMES) - set(ORACLE)
    assert rows_only <= {"query_log_stream"}
