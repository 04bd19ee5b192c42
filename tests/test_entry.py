"""The registered queries against their SQL at the smallest scale."""

import os

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["primary_accuracy", "typed_steps", "fit_loo_stats", "fit_loo_thresholds", "rule_changepoint_single_short",
          "lookahead_own", "retain_under_budget", "oldest_first_blanking", "recall_at_k", "embed_divergence",
          "verdict_binary_search_inclusive", "parse_answers_labelled"]


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cur = duck(SF).execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], cols, cur.fetchall()) == ""
