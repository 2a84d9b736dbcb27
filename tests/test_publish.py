"""Versions appear whole or not at all."""

import pytest
from pyspark.sql import functions as F

from flowloom.plans import publish
from flowloom.plans.run import evaluated


def numbers(spark, n):
    return spark.range(n).withColumn("text", F.col("id").cast("string"))


def test_a_draft_is_invisible_until_it_is_published(spark, tmp_path):
    root = str(tmp_path / "models")
    assert publish.versions(spark, root) == []
    broken = publish.begin(spark, root, "2024.05.01")
    broken.write(numbers(spark, 5), "numbers")  # and then the writer is gone
    with pytest.raises(publish.PublishError):
        publish.open_version(spark, root)
    draft = publish.begin(spark, root, "2024.05.01")
    draft.write(numbers(spark, 7), "numbers")
    assert draft.publish({"selected": "forest"}) == "2024.05.01.2"
    done = publish.open_version(spark, root)
    assert (done.version, done.metadata, done.read("numbers").count()) == ("2024.05.01.2", {"selected": "forest"}, 7)
    assert publish.versions(spark, root) == ["2024.05.01.2"]
    with pytest.raises(publish.PublishError):
        publish.open_version(spark, root, "2024.05.01")


def test_two_writers_get_two_versions_and_publish_once(spark, tmp_path):
    root = str(tmp_path / "models")
    one, two = publish.begin(spark, root, "2024.05.01"), publish.begin(spark, root, "2024.05.01")
    assert one.version != two.version
    for draft, n in ((two, 2), (one, 1)):
        draft.write(numbers(spark, n), "numbers")
        draft.publish({})
    again = publish.Draft(spark, root, one.version)
    with pytest.raises(publish.PublishError):
        again.publish({"other": 1})
    assert publish.open_version(spark, root, one.version).read("numbers").count() == 1
    assert publish.versions(spark, root) == ["2024.05.01", "2024.05.01.2"]
    for day in [f"2024.05.{d:02}" for d in (2, 10)] + ["2024.05.02"] * 9:
        publish.begin(spark, root, day).publish({})
    assert publish.versions(spark, root)[-2:] == ["2024.05.02.10", "2024.05.10"]


def test_changed_tables_are_refused(spark, tmp_path):
    root = str(tmp_path / "models")
    draft = publish.begin(spark, root)
    draft.write(numbers(spark, 4), "numbers")
    draft.publish({})
    numbers(spark, 1).write.mode("append").parquet(f"{draft.path}/numbers")
    with pytest.raises(publish.PublishError):
        publish.open_version(spark, root).read("numbers")


def test_metrics_of_predictions(spark):
    rows = [(0, 0, [0.8, 0.2, 0, 0, 0, 0, 0]), (0, 1, [0.4, 0.6, 0, 0, 0, 0, 0]), (1, 1, [0.1, 0.9, 0, 0, 0, 0, 0])]
    frame = spark.createDataFrame([(y, p, [float(x) for x in s]) for y, p, s in rows], "y int, pred int, proba array<double>")
    metrics, each, confused = evaluated(frame)
    row = metrics.first()
    assert (row.accuracy, row.false_positive_rate, row.attack_detection_rate, row.roc_auc_ovr_macro) == (pytest.approx(2 / 3), 0.5, 1.0, 1.0)
    assert each.where("label = 'ddos'").first().recall == 1.0 and confused.count() == 49
