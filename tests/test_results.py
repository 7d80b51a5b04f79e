from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators import metrics as M
from flowloom.operators import results as R


def test_timing_windows(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([9.0, 9.0, 1.0, 1.0, 2.0, 2.0, 5.0])], "run string, i int, s double")
    assert tuple(R.timing_windows(df, ["run"], "i", "s", 2, 2).first()) == ("r", 2, 1.5, 1.9, 0.5)
    assert R.timing_windows(df.limit(3), ["run"], "i", "s", 2, 2).count() == 0


def test_early_stop(spark):
    scores = [0.1, 0.3, 0.3, 0.2, 0.9]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(scores)], "run string, step int, v double")
    assert tuple(R.early_stop(df, ["run"], "step", "v", 2).first()) == ("r", 1, 0.3, 3)
    assert tuple(R.early_stop(df, ["run"], "step", "v", 3).first()) == ("r", 4, 0.9, 4)


def test_metrics_over_a_fixed_set(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")
    rows = {r["class"]: r for r in M.per_class(p, [0, 1, 2]).collect()}
    assert rows[2]["f1"] == 0 and rows[2]["support"] == 0
    s = M.summary(M.per_class(p, [0, 1, 2])).first()
    assert abs(s["macro_f1"] - (2 / 3 + 2 / 3) / 3) < 1e-8 and abs(s["accuracy"] - 2 / 3) < 1e-8
    assert M.confusion(p, [0, 1, 2]).count() == 9


def test_formulas(spark):
    one = spark.range(1)
    got = one.select(S.step_budget(F.lit(1000), F.lit(256), F.lit(2), F.lit(20)), S.validation_count(F.lit(10), F.lit(4), F.lit(3)), S.argmax(F.array(F.lit(0.5), F.lit(0.5)))).first()
    assert tuple(got) == (20, 3, 0)
    assert one.select(S.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == [0.5, 0.5]


def test_tolerant_choice(spark):
    c = spark.createDataFrame([("g", "a", 0.500, 9), ("g", "b", 0.496, 1), ("g", "c", 0.4, 0)], "g string, id string, score double, seconds int")
    assert R.tolerant_choice(c, ["g"], "score", ["seconds", "id"]).first()["id"] == "b"
