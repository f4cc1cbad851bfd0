import datetime
import json

import pytest

from tallyglass.operators.query import count_by
from tallyglass.plans.staging import new_path, release, shared_folder, stage
from tallyglass.sources import catalog as CT
from tallyglass.sources import files as FI


def test_csv_round_trip_keeps_types_quotes_and_microseconds(spark, rows):
    path = new_path(spark, "csv")
    df = spark.createDataFrame(
        [(1, 'say "hi", you', datetime.datetime(2024, 1, 1, 1, 2, 3, 456789), 1.5), (2, "plain", datetime.datetime(2024, 1, 2), None)],
        "id long, text string, at timestamp_ntz, v double",
    )
    FI.write_table(df, path)
    back = FI.read_csv(spark, path)
    assert back.dtypes == df.dtypes
    assert rows(back.orderBy("id")) == rows(df.orderBy("id"))


def test_missing_spellings_do_not_hide_numbers(spark, rows):
    path = new_path(spark, "csv")
    spark.createDataFrame([("a,b",), ("1,N/A",), ("NULL,2.5",)], "value string").coalesce(1).write.text(path)
    got = FI.read_csv(spark, path)
    assert got.dtypes == [("a", "bigint"), ("b", "double")]
    assert sorted(rows(got), key=str) == sorted([(1, None), (None, 2.5)], key=str)


def test_register_goes_on_after_a_bad_file(spark):
    path = new_path(spark, "csv")
    FI.write_table(spark.createDataFrame([(1, "x")], "a long, b string"), path)
    outcome = FI.register(spark, {"nowhere": path + "-missing", "somewhere": path})
    assert outcome["somewhere"] == "ok" and outcome["nowhere"] != "ok"
    assert spark.table("somewhere").count() == 1


def test_catalog_defaults_and_issues(spark, rows):
    path = new_path(spark, "catalog")
    text = json.dumps(
        {"metrics": [{"column": "revenue"}, {"name": "Lost"}, {"name": "Far", "column": "far", "aggregation": "average"}],
         "dimensions": ["region", "planet"], "time_column": "date", "hierarchies": {"place": ["region", "city"]}},
        indent=1,
    )
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    catalog = CT.load_catalog(spark, path)
    assert catalog.metrics[0] == CT.Metric("revenue", "revenue", "sum", "number", "", "")
    assert catalog.metrics[0].is_total and not catalog.metrics[2].is_total
    assert catalog.hierarchies == {"place": ("region", "city")}
    df = spark.createDataFrame([(1.0, "x")], "revenue double, region string")
    assert [r[1] for r in rows(CT.validate_catalog(df, catalog))] == [
        "Metric 'Lost' is missing a column mapping.",
        "Metric 'Far' column 'far' not found.",
        "Dimension 'planet' not found in dataset.",
        "Time column 'date' not found in dataset.",
    ]


def test_catalog_without_metrics(spark):
    path = new_path(spark, "catalog")
    spark.createDataFrame([('{"dimensions": ["a"]}',)], "value string").coalesce(1).write.text(path)
    catalog = CT.load_catalog(spark, path)
    assert catalog == CT.Catalog((), ("a",), None, {})


def test_saved_results(spark, rows):
    folder = new_path(spark, "results")
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    question = "Count by k " + "x" * 60
    key = FI.save_result(count_by(df, "k"), folder, question)
    other = FI.save_result(df, folder, "All rows", title="Everything")
    cards = {r["key"]: r["title"] for r in FI.saved_results(spark, folder).collect()}
    assert cards == {key: f"Insight: {question[:45]}...", other: "Everything"}
    assert len(key) == 8
    FI.drop_result(spark, folder, other)
    assert [r["key"] for r in FI.saved_results(spark, folder).collect()] == [key]
    assert sorted(rows(FI.load_result(spark, folder, key), "k", "count")) == [("a", 2), ("b", 1)]


def test_a_result_is_published_last(spark, rows, monkeypatch):
    folder = new_path(spark, "results")
    one, two, three = (spark.createDataFrame([(k,)], "v int") for k in (1, 2, 3))
    key = FI.save_result(one, folder, "Q", title="First")

    def lost(*_, **__):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(RuntimeError):
            FI.save_result(two, folder, "Q", title="Second")
    assert rows(FI.load_result(spark, folder, key)) == [(1,)]
    assert [r["title"] for r in FI.saved_results(spark, folder).collect()] == ["First"]
    reader = FI.load_result(spark, folder, key)
    FI.save_result(two, folder, "Q", title="Second")
    # who reads the version before goes on
    assert rows(reader) == [(1,)] and rows(FI.load_result(spark, folder, key)) == [(2,)]
    FI.save_result(three, folder, "Q")
    assert rows(FI.load_result(spark, folder, key)) == [(3,)] and FI.saved_results(spark, folder).count() == 1
    with pytest.raises(FileNotFoundError):
        FI.load_result(spark, folder, "none")


def test_insight_export_fills_the_priority(spark, rows):
    df = spark.createDataFrame(
        [("trend", None, "T", "D", "sales", 1.0)], "type string, priority string, title string, description string, metric string, value double"
    )
    got = FI.insights_csv(df)
    assert got.columns == ["Type", "Priority", "Title", "Description", "Metric", "Value"]
    assert rows(got) == [("trend", "medium", "T", "D", "sales", 1.0)]


def test_staging_uses_the_named_folder_and_can_be_released(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(10), "t")
    assert df.count() == 10
    release(spark)
    again = stage(spark.range(3), "t")
    assert again.count() == 3
