"""Registry of checks: name -> (Spark query, SQL text or None)."""
from ringside.checks.tables import Tables, with_tables

QUERIES, ORACLES, MODULE = {}, {}, {}


def check(name, sql=None, needs=(), **extra):
    """Register a query over derived tables and, when it can be said in SQL, its SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        MODULE[name] = fn.__module__.rsplit(".", 1)[1]
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql, **extra)
        return fn
    return register
