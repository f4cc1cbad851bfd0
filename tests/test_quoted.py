"""Quoted CSV read by byte ranges."""

import csv
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyglass.sources import files, quoted


@pytest.fixture
def tiny_ranges(spark):
    """Files are cut into ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(path, rows, header=("id", "said", "note"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows([header, *rows])
    return str(path)


ROWS = [
    (k, ["plain", 'a "quoted" word', "two\nlines", 'ends in "\n', '\n\n"",,\n', "comma, here", "é\n" * (k % 7), '"'][k % 8] + f" {k}", "x" * (k % 23))
    for k in range(300)
]


@pytest.mark.parametrize("size", [400, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_any_size_give_the_same_records(spark, tmp_path, tiny_ranges, size, end):
    path = written(tmp_path / "t.csv", ROWS, end=end)
    tiny_ranges(size)
    cut = quoted.cut_records(spark, path)
    assert cut.rdd.getNumPartitions() >= min(os.path.getsize(path) // size, 2) or size == 10**6
    got = sorted((int(r["id"]), r["said"], r["note"] or "") for r in files.read_csv(spark, path, schema="id long, said string, note string").collect())
    assert got == sorted(ROWS)


def test_a_value_longer_than_several_ranges(spark, tmp_path, tiny_ranges):
    rows = [(1, "a\n" * 400, "n"), (2, 'b""\n,"' * 300, "m"), (3, "c", "")]
    path = written(tmp_path / "t.csv", rows)
    tiny_ranges(200)
    got = sorted((r["id"], r["said"], r["note"] or "") for r in files.read_csv(spark, path).collect())
    assert got == rows


def test_stray_quotes_in_plain_values_do_not_open(spark, tmp_path, tiny_ranges):
    path = tmp_path / "t.csv"
    path.write_text('id,size\n' + "".join(f'{k},{k}" pipe\n' for k in range(50)) + '50,"two\nlines"\n')
    tiny_ranges(100)
    got = {r["id"]: r["size"] for r in files.read_csv(spark, str(path)).collect()}
    assert len(got) == 51 and got[3] == '3" pipe' and got[50] == "two\nlines"


def test_documents_equal_what_duckdb_reads(spark, data, tmp_path, tiny_ranges):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    files.write_table(docs.coalesce(1), str(tmp_path / "docs"))
    tiny_ranges(20_000)
    got = files.read_csv(spark, str(tmp_path / "docs"))
    assert quoted.cut_records(spark, str(tmp_path / "docs")).rdd.getNumPartitions() > 20
    assert dict(got.dtypes)["doc_id"] == "bigint" and dict(got.dtypes)["n_chars"] == "bigint"
    query = f"SELECT doc_id, md5(text) FROM read_csv('{tmp_path}/docs/*.csv', header=true, quote='\"', escape='\"', max_line_size=10000000)"
    assert sorted(tuple(r) for r in got.select("doc_id", F.md5("text")).collect()) == sorted(duckdb.sql(query).fetchall())


def test_several_files_one_without_rows(spark, tmp_path):
    a, b = written(tmp_path / "a.csv", ROWS[:20]), written(tmp_path / "b.csv", [])
    assert files.read_csv(spark, [a, b]).count() == 20


def test_states_of_a_line():
    assert quoted.ends_inside('1,"open', False) and not quoted.ends_inside('1,"shut"', False)
    assert quoted.ends_inside("no quote", True) and not quoted.ends_inside('shut",2', True)
    assert quoted.ends_inside('still ""', True) and quoted.ends_inside('shut","open again', True)
    assert not quoted.ends_inside('5" pipe,2', False) and not quoted.ends_inside('""', False)
