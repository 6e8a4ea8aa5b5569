"""Train and test rows where a class is too small to be split."""

from logwarden.operators import ranks as N


def test_single_row_class_falls_back_to_one_split(spark):
    rows = [(i, "a") for i in range(49)] + [(49, "b"), (50, None)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = N.train_test_split(df, "label", "id").collect()
    assert len(got) == 50 and sum(r.is_test for r in got) == 10 and set(got[0].asDict()) == {"id", "label", "is_test"}
    both = N.train_test_split(df.where("id < 40 or id = 49").union(spark.createDataFrame([(90, "b")], df.schema)), "label", "id").collect()
    assert sum(r.is_test for r in both if r.label == "a") == 8 and sum(r.is_test for r in both if r.label == "b") == 0
