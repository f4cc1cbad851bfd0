"""Inputs that are easily got wrong: many columns, constants, dotted names, quoted line breaks, the staging folder."""

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import forecast as FC
from tallyglass.operators import insights as I
from tallyglass.operators import query as Q
from tallyglass.operators import series as S
from tallyglass.operators import stats as A
from tallyglass.plans import staging
from tallyglass.sources import catalog as CT
from tallyglass.operators import semantic as M
from tallyglass.sources import files as FI


@pytest.fixture(scope="module")
def many(spark):
    """Six numeric columns of which only the last one moves, and three categories."""
    flat = [((F.col("id") * (7 + k) % 11) + 20.0).alias(f"m{k}") for k in range(5)]
    return spark.range(600).select(
        (F.lit("2024-01-01").cast("date") + F.col("id").cast("int")).cast("timestamp_ntz").alias("at"),
        *flat,
        (F.col("id") * 1.0).alias("late"),
        *[F.concat(F.lit(c), (F.col("id") % 3).cast("string")).alias(c) for c in "xyz"],
    )


def test_findings_beyond_the_fourth_column(many):
    got = I.all_insights(many, ["at"], staged=False).select("type", "metric").collect()
    assert ("trend", "late") in [tuple(r) for r in got]
    assert {r["metric"] for r in S.trend_insight(many, None, ["at"]).collect()} == {"late"}
    assert {r["category"] for r in A.performance_gap_insight(many, None, ["late"], min_pct=0.0).collect()} <= {"x", "y", "z"}
    assert S.trend_insight(many, None, ["at"], max_metrics=2).count() == 0


def test_constants_have_no_correlation(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("a"), F.lit(0.7).alias("b"), F.col("id").cast("double").alias("c"))
    assert [r["r"] for r in A.correlation_matrix(df).collect()] == [None, None, None]
    assert A.correlation_insight(df).count() == 0 and A.correlation(df, "a", "b").first()["r"] is None
    gappy = df.withColumn("a", F.when(F.col("c") > 3, F.col("a")))
    assert [r["r"] for r in A.correlation_matrix(gappy).collect()] == [None, None, None]


def test_every_member_against_the_rest(spark):
    rows = [(g, float(v + shift)) for g, shift in (("a", 0), ("b", 0), ("c", 5)) for v in range(40)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["group2"]: r for r in A.ttest_insight(df, "g", ["v"], "rest", alpha=1.1).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["diff_pct"] > 0 and got["c"]["t"] < 0
    two = A.ttest_measures(df.withColumn("g", F.when(F.col("g") == "c", "c").otherwise("rest")), "g", ["v"]).first()
    assert abs(abs(got["c"]["t"]) - abs(two["t"])) < 1e-9


def test_names_with_dots(spark):
    df = spark.createDataFrame([("n", 1.0, "2024-01-01"), ("s", 3.0, "2024-01-02"), ("s", 4.0, "2024-01-03")], "`u.region` string, `u.price` double, `u.day` string")
    assert Q.aggregate(df, "u.price", "sum", "u.region", order="desc").first()["u.price"] == 7.0
    assert Q.aggregate(df, "u.price", "median", "u.region").count() == 2 and Q.count_by(df, "u.region").first()["count"] == 2
    assert Q.leader_laggard(df, "u.price", "sum", "u.region").first()["leader"] == "s"
    assert Q.category_breakdown(df, "u.region", "u.price", share=True).first()["share"] == 0.125
    assert Q.pivot_mean(df, "u.day", "u.region", "u.price").count() == 3
    assert S.series(df, "u.day", "u.price").count() == 3
    assert FC.forecast(df, "u.day", "u.price", periods=2).count() == 5
    catalog = CT.Catalog((CT.Metric("P", "u.price"),), ("u.region",), "u.day", {"h": ("u.region",)})
    assert M.governed_metrics(df, catalog, ["u.region"]).count() == 2 and M.drill_down(df, catalog, "h").count() == 3
    assert A.performance_gap_insight(df, ["u.region"], ["u.price"], 0.0).count() == 1


def test_line_breaks_in_quotes_survive(spark):
    path = staging.new_path(spark, "csv")
    rows = [("one\ntwo, \"three\"", 1), ("plain", 2)]
    FI.write_table(spark.createDataFrame(rows, "t string, n long"), path)
    assert sorted(map(tuple, FI.read_csv(spark, path).collect())) == sorted(rows)


def test_text_dates_are_put_in_order(spark):
    df = spark.createDataFrame([("01/03/1972", 3.0), ("01/01/1970", 1.0), ("01/02/1971", 2.0)], "day string, v double")
    assert [r["y"] for r in S.series(df, "day", "v").collect()] == [1.0, 2.0, 3.0]


def test_staging_needs_no_local_folder(spark):
    folder = staging.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert not hasattr(staging, "tempfile")


def test_staging_needs_a_shared_folder_on_a_cluster():
    """In local mode the warehouse will do; elsewhere a missing setting is an error."""
    from types import SimpleNamespace

    from tallyglass.plans.staging import shared_folder

    def session(master, **settings):
        conf = {"spark.sql.warehouse.dir": "/w/", **{k.replace("__", "."): v for k, v in settings.items()}}
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))

    assert shared_folder(session("local[4]")) == "/w/_staging"
    assert shared_folder(session("spark://a:7077", spark__checkpoint__dir="/shared/")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://a:7077"))


def test_members_are_measured_once_for_all_analyses(spark):
    """The shared pass gives what each analysis finds alone; the table itself is read once for all categories."""
    from tallyglass.operators.members import measure_members
    from tallyglass.plans.cuts import rank_cuts

    rows = [(i, f"r{i % 3}" if i % 11 else None, i % 4, float(i % 17) if i % 5 else None, (i * i) % 23 + (i % 3) * 9) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, region string, kind int, x double, y int").repartition(5)
    cats, metrics = ["region", "kind"], ["y", "x"]
    _, (half,) = rank_cuts(df, ["id"], lambda n: [n // 2])
    members = measure_members(df, cats, ["x", "y"], half)
    assert members.table.count() == 7
    near = lambda frame: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect())
    assert near(A.performance_gap_insight(df, cats, metrics, 0.0, members=members)) == near(A.performance_gap_insight(df, cats, metrics, 0.0))
    assert near(S.half_changes(df, metrics, cats, ["id"], members=members)) == near(S.half_changes(df, metrics, cats, ["id"], half))
    for c in cats:
        assert near(A.ttest_against_rest(df, c, metrics, members=members).fillna(-1.0)) == near(A.ttest_against_rest(df, c, metrics).fillna(-1.0))
