from pyspark.sql import functions as F

from motionlake.operators import textguard as g


def test_guards(spark):
    df = spark.createDataFrame([("Angle 12.5, twice 3, never 99 km/h",), ("ﬁne",), ("```json\n{\"summary\": \"ok\"}\n```",), (None,)], "t string")
    allowed = g.allowlist(F.array(F.lit(12.5)))
    got = df.select(g.violations(F.col("t"), allowed), g.nfkc("t"), g.parse_draft(F.col("t"))["summary"]).collect()
    assert sorted(got[0][0]) == ["99", "km/h"] and got[1][1] == "fine" and got[2][2] == "ok" and got[3][1] is None
    mph = spark.createDataFrame([("at 61 mph",), ("61 mph or 70 mph",), ("61 mph 61 mph 61 mph",)], "t string").select(g.mph_binding(F.col("t"), F.lit(61))).collect()
    assert [r[0] for r in mph] == [True, False, False]


def test_enforce(spark):
    df = spark.createDataFrame([("fine 2", "7 bad", "ok"), ("8", "9", "10")], "a string, b string, c string")
    got = g.enforce(df, ["a", "b", "c"], g.allowlist(F.array().cast("array<double>"))).collect()
    assert [tuple(r) for r in got] == [("fine 2", None, "ok", False), (None, None, None, True)]


def test_percent_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(3, 0), (0, 0), (3, 8), (1, 8), (None, 5)], "part long, total long")
    assert [r[0] for r in df.select(g.percent(F.col("part"), F.col("total"))).collect()] == [0, 0, 38, 12, 0]


def test_sign_percent_and_units(spark):
    """A sign or a percent is part of a number; each unit that is never measured is banned, mph only without its value."""
    df = spark.createDataFrame([("-5 and 40%, +3.25 or 5",), ("a long rally at 30 kph, six feet",), ("61 mph",), ("no number",)], "t string")
    allowed = g.allowlist(F.array(F.lit(5.0)))
    got = [sorted(r[0]) for r in df.select(g.violations(F.col("t"), allowed)).collect()]
    assert got == [["+3.25", "-5", "40%"], ["30", "feet", "kph", "rally"], ["61"], []]
    for value, text, ok in ((61, "61mph", True), (61, "61  mph", False), (61, "161 mph", False), (None, "61 mph", False), (None, "graphs", True), (61, "MPH 61", False), (61, "nothing", True)):
        assert spark.createDataFrame([(text, value)], "t string, v int").select(g.mph_binding(F.col("t"), F.col("v"))).first()[0] == ok, text
