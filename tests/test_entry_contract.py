"""The driver contract of __spark_entry__.py."""
import __spark_entry__ as E
from paylake.plans import catalog


def test_registry_shape():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert all(callable(f) and (f.__doc__ or "").strip() for f in q.values())
    own = catalog.queries()
    assert set(own) <= set(q) and set(own) - set(catalog.oracle_sql()) == {"approx_users"}   # the only rows-only query
    assert not any(name.startswith("op") or "pipeline" in name for name in own)


def test_entry_schema_is_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema
    assert [f.name for f in a.schema.fields][:3] == ["payment_date", "total_revenue", "total_paid_orders"]
