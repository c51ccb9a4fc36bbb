import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"repo_id", "metric_id", "window_a", "ks_statistic", "psi", "direction"} <= set(df.columns)
    df.collect()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_few_queries_run(spark):
    q = entry.queries()
    for name in ("window_statistics", "metric_results", "discover_edges", "confusion_matrix", "parse_commit_log"):
        assert q[name](spark, SF).count() > 0
