import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_optional_subpackage():
    from threadloom import queries

    assert len(queries.queries()) > 70
    assert "exchange_segments" in queries.oracle_sql()


def test_plans_push_filters_and_prune_columns(spark):
    plan = entry.queries()["filtered_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label, [1,3])" in plan
    plan = entry.queries()["excluded_by_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string,source:string>" in plan
