import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 30
    assert entry.entry(spark).count() >= 0


def test_core_queries_run(spark):
    from paperloom.plans import catalog

    for name, f in catalog.QUERIES.items():
        df = f(spark, SMALL)
        assert df.columns == f(spark, SMALL).columns and df.count() >= 0, name
