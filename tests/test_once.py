"""Expressions of a row are worked out once, however many filters and columns name them."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_cards_are_parsed_once(spark):
    plan = _plan(spark, "parse_cards")
    assert plan.count("from_json(") == 1 and plan.count("regexp_extract_all(") == 1


def test_responses_are_parsed_once(spark):
    plan = _plan(spark, "schema_check")
    assert plan.count("from_json(") == 1 and plan.count("regexp_extract_all(") == 1


def test_rules_read_a_passage_once(spark):
    """Words, numbers and their array stand in the filter, not the question's making."""
    plan = _plan(spark, "accepted_questions")
    assert plan.count("regexp_extract_all(") <= 7 and plan.count("slice(") <= 10


def test_word_lists_are_made_once(spark):
    assert _plan(spark, "groundedness").count("array_distinct(") == 2
