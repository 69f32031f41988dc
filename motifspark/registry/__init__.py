"""Registered queries: one Spark job per operator, with the SQL it is checked against where SQL can say it."""

from importlib import import_module

from motifspark.session import tune

QUERIES = {}
ORACLES = {}
AREAS = ("scan", "sequences", "assay", "spots", "training", "scoring", "specificity", "thresholds", "assembly", "homology",
         "consolidation", "search", "files", "programs")


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(tune(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all():
    for area in AREAS:
        import_module(f"motifspark.registry.{area}")
    return QUERIES, ORACLES


def r6(column):
    """Rounded for comparison; adding zero turns -0 into 0."""
    from pyspark.sql import functions as F

    return F.round(column, 6) + F.lit(0.0)


def q6(expr):
    return f"(round({expr}, 6) + 0.0)"


def r9(column):
    """For values within a few units of zero, where six digits would meet exact ties."""
    from pyspark.sql import functions as F

    return F.round(column, 9) + F.lit(0.0)


def q9(expr):
    return f"(round({expr}, 9) + 0.0)"
