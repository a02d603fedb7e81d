"""Registered queries against their SQL, and plan rules.

A part of the queries is compared by default; DOCKETRY_ALL=1 compares all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
DEFAULT = """session_rollup dashboard_by_scope history_window used_sources citation_links document_search resolved_labels
 catalog_pages upserted_and_capped reconciled_uploads upload_summary folded_turns debounced_notes ready_templates blocking_items
 document_blocks validation_prompts search_links submitted_file_ids session_log_turns linked_search""".split()
NAMES = sorted(CHECKS) if os.environ.get("DOCKETRY_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(CHECKS[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    index = [names.index(c) for c in columns]
    assert got == sorted((tuple(canon(r[i]) for i in index) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", ["citation_links", "document_search", "resolved_labels", "resolved_presets", "blocking_items", "topic_documents"])
def test_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["upserted_and_capped", "newest_files", "first_files"])
def test_caps_are_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_reach_the_scan(spark, tmp_path):
    from docketry.sources import logs

    docs = spark.createDataFrame([(str(i), "A" if i % 2 else "B") for i in range(4)], "id string, category string")
    docs.write.parquet(str(tmp_path / "docs"))
    df = logs.read_documents(spark, str(tmp_path / "docs"), category=" A ", id="").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,A)" in plan and "ReadSchema: struct<id:string,category:string>" in plan
    assert df.count() == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
