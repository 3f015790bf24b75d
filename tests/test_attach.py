import pytest

from pairsim.operators import submission


def test_positional_attach(spark):
    template = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "id string, k int")
    preds = spark.createDataFrame([(20, 1.26), (10, 9.0), (30, None)], "at int, prediction double")
    got = submission.attach_by_position(template, preds, ["k"], ["at"]).collect()
    assert {r.id: r.target for r in got} == {"a": 5.0, "b": 1.3, "c": None}
    with pytest.raises(ValueError, match="3 rows in the template, 2 predictions"):
        submission.attach_by_position(template, preds.where("at < 30"), ["k"], ["at"])
    assert submission.attach_by_position(template.limit(0), preds.limit(0), ["k"], ["at"]).count() == 0
