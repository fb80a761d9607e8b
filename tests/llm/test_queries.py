import pytest

from plinth.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["identity_id_a", "identity_id_b"],
    "p2_found": ["commit_id", "field", "kind"],
    "p3_found": ["commit_id", "location", "line_no"],
    "p4_found": ["field", "value"],
    "p6_found": ["commit_id", "path"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
    if name == "p1_found":
        assert all(a < b for a, b in rows)


def test_every_problem_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {"p1", "p2", "p3", "p4", "p6", "p7", "p8", "p9"}
    assert set(SQL) <= set(QUERIES)


def test_top_k_plan(spark):
    """Partial aggregation before the shuffle, local top-k after it, only the needed column read."""
    plan = QUERIES["p4_top_paths"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("HashAggregate") == 2 and "ReadSchema: struct<path:string>" in plan


def test_found_equals_the_operators_other_views(spark):
    shares = {r.doc_id for r in QUERIES["p9_shares"](spark, SF).collect() if r.repetitive}
    assert shares == {r.doc_id for r in QUERIES["p9_found"](spark, SF).collect()}
    members = {}
    for r in QUERIES["p1_members"](spark, SF).collect():
        members.setdefault(r.person_id, []).append(r.identity_id)
    pairs = {(a, b) for v in members.values() for a in v for b in v if a < b}
    assert pairs == {tuple(r) for r in QUERIES["p1_found"](spark, SF).collect()}
