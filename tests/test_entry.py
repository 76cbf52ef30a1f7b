import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_names_and_oracles_match():
    import __spark_entry__ as e

    plans, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(plans) and len(plans) > 100
    for n in (1, 3, 4, 6):
        assert f"p{n}_found" in sqls


def test_core_stands_without_the_training_subpackage(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    assert "p1_found" in e.queries() and "p5_found" not in e.queries()


def test_entry_and_a_few_queries_against_their_oracles(spark):
    import __spark_entry__ as e
    from tools.compare import oracle_rows, spark_rows

    assert e.entry(spark).count() > 0
    for name in ("p1_found", "p3_found", "p4_found", "p6_found", "kappa", "chunk_pack", "range_join"):
        assert spark_rows(e.queries()[name](spark, DATA)) == oracle_rows(DATA, e.oracle_sql()[name]), name


def test_json_lines_hold_every_document(spark, tmp_path):
    import __spark_entry__ as e
    from tools.compare import oracle_rows, spark_rows

    rows = [(1, "one line"), (2, "a\nb\r\nc\rd"), (3, ""), (4, None), (5, "\n"), (6, '"\\\t\u2028é\x00'), (7, "x\n" * 50_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in e.queries()["json_lines_folder"](spark, str(tmp_path)).collect()}
    assert got == {i: t for i, t in rows if t is not None}
    assert spark_rows(e.queries()["json_lines_folder"](spark, DATA)) == oracle_rows(DATA, e.oracle_sql()["json_lines_folder"])


def test_clause_sections_of_every_document(spark, tmp_path):
    import __spark_entry__ as e
    from tools.compare import oracle_rows, spark_rows

    rows = [(1, "no clause here"), (2, "Head\nCLAUSE 1 a\nCLAUSE 2 b"), (3, ""), (4, None), (5, "clause 1 in lower case\nclause 2")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["sections"] for r in e.queries()["clause_sections"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 3, 3: 0, 5: 1}
    assert spark_rows(e.queries()["clause_sections"](spark, DATA)) == oracle_rows(DATA, e.oracle_sql()["clause_sections"])
