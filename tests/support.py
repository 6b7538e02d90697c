"""Helpers shared by the tests (not in conftest, whose module name every folder's conftest has)."""

SF_SMALL = "/root/testdata/sf0.001"


def one_col(spark, values, name="v", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
