
from rillflow.operators import artifacts


def test_repair_takes_every_line_of_a_record(spark):
    long = "h\nv0,x\n" + "".join(f"x,v{i}\n" for i in range(1, 1501))
    got = {r.run: r for r in artifacts.repair_csv(spark.createDataFrame([("long", long), ("head", "a,b\n"), ("none", ""), ("null", None)], "run string, text string")).collect()}
    assert got["long"]["values"] == ["v0", "x", *(f"v{i}" for i in range(1, 1501))]
    assert got["head"].names == ["a", "b"] and got["head"]["values"] == [""] and got["null"]["values"] is None
