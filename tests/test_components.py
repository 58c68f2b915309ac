from memlattice.operators.components import components


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z", "y"), ("z", "y")], "a string, b string")
    got = {r.node: r.component for r in components(links).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["z"] == "y" and len(got) == 43


def test_nothing_to_link(spark):
    assert components(spark.createDataFrame([("a", None), (None, "b")], "a string, b string")).collect() == []
