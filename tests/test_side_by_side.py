"""Fits run side by side, and steps too long for the JVM's compiler run apart."""

import threading

from flowloom.operators import clean
from flowloom.plans import models
from flowloom.registry import CLASSES, SOURCE_COLUMNS
from flowloom.session import configure


def test_work_runs_side_by_side_and_keeps_its_order(spark):
    meet = threading.Barrier(5, timeout=60)  # breaks if one waits for another

    def work(i):
        meet.wait()
        return spark.range(i).count()

    assert models.side_by_side(work, [5, 4, 3, 2, 1]) == [5, 4, 3, 2, 1]
    assert models.side_by_side(work, []) == []


def test_classes_of_boosted_trees_are_fitted_side_by_side():
    assert models.boosted_trees(1, 1).getStages()[-1].getParallelism() == len(CLASSES)


def test_tables_of_wide_features_run_under_the_limit_of_the_jvm_compiler(spark):
    configure(spark)
    columns = ", ".join(f"id % {i + 7} AS `{c}`" for i, c in enumerate(SOURCE_COLUMNS))
    raw = spark.sql(f"SELECT id AS capture_order, 'a' AS source_file, 'BENIGN' AS raw_label, {columns} FROM range(1000)")
    rows = clean.labelled_features(raw, ["capture_order"])
    limit = int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
    assert limit <= 8000 and rows.count() == 1000
