"""Features, cleaning and splitting on small files with known faults."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions.flows import from_records, from_source_columns, label_text
from flowloom.operators import clean, split
from flowloom.registry import FEATURE_NAMES, MEASURED, SOURCE_COLUMNS
from flowloom.sources import flows


def one_flow(spark, **changes):
    values = {c: "10" for c in SOURCE_COLUMNS} | {
        "Flow Duration": "2000000",
        "Total Fwd Packets": "6",
        "Total Backward Packets": "4",
        "Total Length of Fwd Packets": "600",
        "Total Length of Bwd Packets": "400",
    }
    values |= changes
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_units_and_rates(spark):
    row = from_source_columns(one_flow(spark), []).first()
    assert row.flow_duration_s == 2.0
    assert row.flow_iat_mean == pytest.approx(1e-5)
    assert (row.flow_bytes_per_s, row.flow_packets_per_s) == (500.0, 5.0)


@pytest.mark.parametrize("bad", ["NaN", "Infinity", "-Infinity", "", "text"])
def test_unreadable_numbers_and_zero_duration(spark, bad):
    row = from_source_columns(one_flow(spark, **{"Flow Duration": "0", "Flow IAT Std": bad}), []).first()
    assert (row.flow_bytes_per_s, row.flow_packets_per_s, row.flow_iat_std) == (0.0, 0.0, 0.0)


def test_infinite_duration(spark):
    row = from_source_columns(one_flow(spark, **{"Flow Duration": "Infinity"}), []).first()
    assert (row.flow_duration_s, row.flow_bytes_per_s) == (0.0, 0.0)


def test_live_records_equal_file_rows(spark):
    offline = from_source_columns(one_flow(spark), [])
    live = offline.withColumns({"flow_bytes_per_s": F.lit(-1.0), "extra": F.lit(3)})
    assert from_records(live, []).first() == offline.first()


def test_missing_feature_is_named(spark):
    rows = from_source_columns(one_flow(spark), []).drop("syn_flag_count")
    with pytest.raises(ValueError, match="syn_flag_count"):
        from_records(rows, [])


def test_label_text(spark):
    rows = spark.createDataFrame([("Web Attack ï¿½ XSS",), (" DoS Slowhttptest ",)], "l string")
    assert [r[0] for r in rows.select(label_text(F.col("l"))).collect()] == ["web attack xss", "dos slowhttptest"]


def test_cleaning_counts(spark, flow_dir):
    raw = flows.read_flow_csvs(spark, flow_dir)
    clean.require_known_labels(raw)
    report = clean.cleaning_report(raw, flows.CSV_ORDER).first()
    assert report.dropped_rare_classes == 5
    assert report.dropped_negative_duration == 3
    assert report.dropped_exact_duplicates == 6
    kept = clean.clean(raw, flows.CSV_ORDER)
    counts = {r.label: r["count"] for r in kept.groupBy("label").count().collect()}
    assert counts["webattack"] == 100 and len(counts) == 7
    assert sum(counts.values()) == report.rows_kept
    assert report.rows_loaded == report.rows_kept + 14 + report.dropped_conflicting_labels


def test_unknown_label_fails(spark, flow_dir):
    raw = flows.read_flow_csvs(spark, flow_dir).withColumn("raw_label", F.lit("Something New"))
    with pytest.raises(ValueError, match="something new"):
        clean.require_known_labels(raw)
    with pytest.raises(Exception, match="unmapped label"):
        clean.clean(raw, flows.CSV_ORDER).collect()


def test_missing_files_and_columns(spark, flow_dir, tmp_path):
    with pytest.raises(FileNotFoundError):
        flows.read_flow_csvs(spark)
    (tmp_path / "x.csv").write_text("Label, Flow Duration\nBENIGN,1\n")
    with pytest.raises(ValueError, match="Total Fwd Packets"):
        flows.read_flow_csvs(spark, str(tmp_path))


def test_split_follows_the_file_order(spark, flow_dir):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # many splits per file
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = flows.read_flow_csvs(spark, flow_dir)
        assert raw.select("source_file", "file_block_start").distinct().count() > 6
        kept = clean.clean(raw, flows.CSV_ORDER)
        done = split.temporal_split(kept, flows.CSV_ORDER, block="file_block_start").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    groups = {}
    for r in sorted(done, key=lambda r: (r.source_file, r.file_block_start, r.row_id)):
        groups.setdefault(r.grp, []).append(r)
    for rows in groups.values():
        assert [r.position for r in rows] == list(range(len(rows)))
        cut = int(len(rows) * 0.7)
        assert [r.is_train for r in rows] == [i < cut for i in range(len(rows))]
        folds = [r.fold for r in rows if r.is_train]
        assert folds == sorted(folds) and set(folds) == {0, 1, 2, 3, 4}
    share = sum(r.is_train for r in done) / len(done)
    assert 0.65 < share < 0.72
    assert len({r.label for r in done if r.is_train}) == len({r.label for r in done if not r.is_train}) == 7


def test_cap_per_class(spark):
    rows = spark.createDataFrame([("x" if i < 8 else "y", i) for i in range(10)], "label string, id long")
    got = split.cap_per_class(rows, 3, "id", 1).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"x": 3, "y": 2}


def test_first_rows_and_digest(spark, flow_dir, tmp_path):
    raw = flows.read_flow_csvs(spark, flow_dir)
    first = flows.first_rows(raw, 3).collect()
    assert [r["Flow Duration"] for r in first][:2] == ["0", "-5"] and first[0].source_file == "Friday.csv"
    one = flows.dataset_digest(spark, flow_dir).first()[0]
    assert one == flows.dataset_digest(spark, flow_dir).first()[0]
    (tmp_path / "a.csv").write_text("x\n")
    assert one != flows.dataset_digest(spark, str(tmp_path)).first()[0]


def test_connection_records(spark, tmp_path):
    line = ",".join(["0", "tcp", "http", "SF", *["1"] * 37, "neptune", "21"])
    (tmp_path / "k.txt").write_text(f"{line}\n{line}\n")
    rows = flows.read_connections(spark, str(tmp_path))
    assert len(rows.columns) == 43 and rows.first().attack == "neptune"
    assert len(MEASURED) == 35 and len(FEATURE_NAMES) == 37
