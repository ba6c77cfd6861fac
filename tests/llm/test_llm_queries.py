"""The queries of the text operators run on the smallest tables, whole."""

import pytest
from compare import TABLES

from peptrail.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(TABLES)).count() > 0


def test_all_text_is_in_units(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    units = {}
    for r in QUERIES["p8_found"](spark, str(TABLES)).orderBy("doc_id", "start_char").collect():
        units.setdefault(r["doc_id"], []).append(docs[r["doc_id"]][r["start_char"] : r["end_char"]])
    assert {d: "".join("".join(u).split()) for d, u in units.items()} == {d: "".join(t.split()) for d, t in docs.items() if t.strip()}
