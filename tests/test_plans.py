"""Plans: no nested loops, scans of the columns used, filters at the scan."""

import pytest

import __spark_entry__ as entry

SF = entry.SMOKE
OVER_TABLES = [
    "align_pairs", "length_gate", "sentence_counts", "unit_facts", "fidelity_forward", "fidelity_reverse", "doc_drift", "block_spans", "partition_ledger", "page_breaks", "chunk_pack", "hygiene_tails", "terms_in_texts", "html_links", "html_residue", "duplicate_units",
    "pricing_summary", "local_suppliers", "customers_without_urgent_orders", "returned_orders", "top_customers", "nation_sets", "user_sessions", "event_windows", "census_rollup",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", OVER_TABLES)
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_what_is_used(spark):
    text = plan(entry.queries()["pricing_summary"](spark, SF))
    assert "l_comment" not in text and "l_partkey" not in text
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in text
    text = plan(entry.queries()["duplicate_units"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    assert "n_chars" not in text


def test_short_glued_and_empty_passages_are_found(spark, tmp_path):
    spark.createDataFrame([(1, "two words"), (2, "漢字"), (3, "the longest inner word is cut"), (4, None), (5, "absent"), (6, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x two  words y"), (2, "是漢\n字也"), (3, "see thelongest inn\ner word is cut here"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["fidelity_forward"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 4, 1), (5, 0, None), (6, 0, None)]
