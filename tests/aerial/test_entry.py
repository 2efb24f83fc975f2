import __spark_entry__
import bench
from aerolith import catalog


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["img_lhs", "img_rhs"] and df.count() > 0


def test_catalogue():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert all(callable(q) for q in queries.values())
    own = [n for n in bench.HEADLINE if not n.startswith("op") and n != "pipeline"]
    assert set(own) <= set(catalog.QUERIES)
