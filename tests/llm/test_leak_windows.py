"""Leaks of dense and short items, with names at beginnings, and of passages."""

import pytest

from parcelspark.llm import templates

LONG = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(59))
CASES = {
    "dense": ("Add 12 km 5 m 30 cm and 7 km 8 m 45 cm", "Please: Add 12 km 5 m 30 cm and 7 km 8 m 45 cm now", "Please: Add 13 km 6 m 31 cm and 9 km 4 m 46 cm now"),
    "short": ("Capital of France", "Tell the capital of France", "Tell the capital of Spain"),
    "heading": ("What is the largest known lake", "Q1\nWhat is the largest known lake", "Q1\nWhat is the smallest known lake"),
    "names": ("Tom has many green apples at home. Tom gives away nearly half.", "Ann has many green apples at home. Ann gives away nearly half.",
              "Ann has many green apples at home. Bob gives away nearly half."),
    "passage": (LONG, "some text " + " ".join(LONG.split()[20:45]), "some text " + " ".join(LONG.split()[20:32])),
}


@pytest.fixture(scope="module")
def leaks(spark):
    items = spark.createDataFrame([(name, case[0]) for name, case in CASES.items()], "item_id string, text string")
    docs = spark.createDataFrame([(f"{name}{k}", case[k]) for name, case in CASES.items() for k in (1, 2)], "doc_id string, text string")
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items).collect()}


@pytest.mark.parametrize("name", ["dense", "short", "heading", "names", "passage"])
def test_only_the_first_document_leaks(leaks, name):
    assert (f"{name}1", name) in leaks
    assert (f"{name}2", name) not in leaks
