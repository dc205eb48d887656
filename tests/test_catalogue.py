"""Every query of the catalogue against its SQL."""

import pytest
from conftest import DATA, rows_of

from leafmill.plans import catalogue, documents  # noqa: F401


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_plans_have_no_cartesian_product(spark):
    for name in ("q20_struck_words", "q21_words_in_cells", "q21b_words_outside", "q38_crossing_rows", "q23_occurrence_join"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_spliced_links_by_hand(spark):
    """q22b against a plain walk over each text."""
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    got = {r["doc_id"]: r["text_sha"] for r in catalogue.QUERIES["q22b_spliced_links"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for doc, t in texts.items():
        out, at = "", 0
        for k, first in enumerate(x + doc % 13 for x in (0, 40, 46, 300, 2000)):
            if first + 3 <= len(t):
                a, b = t[:first].rfind(" ") + 1, t.find(" ", first + 3)
                b = len(t) if b < 0 else b
                if a >= at:
                    out, at = out + t[at:a] + f"[{t[a:b]}](u{k})", b
        assert got[doc] == hashlib.sha256((out + t[at:]).encode()).hexdigest(), doc
