"""CSV over many splits of one file, with line breaks in fields, against the csv module of Python."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from tonality.sources.csv_records import csv_records, read_csv
from tonality.sources.utterances import CSV_READ_OPTIONS

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def field(rng):
    return "".join(rng.choice(["x", "yé", ",", "\"", "\n", "\n\n", " ", "line\nbreak"]) for _ in range(rng.choice([0, 1, 3, 8, 400 if rng.random() < 0.05 else 5])))


def written(path, rows):
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    w.writerow(["a", "b", "c"])
    w.writerows(rows)
    path.write_text(out.getvalue(), newline="")


def read(spark, path, **options):
    return read_csv(spark, str(path), SCHEMA, **{**CSV_READ_OPTIONS, **options})


def test_one_file_many_tasks(spark, small_splits, tmp_path):
    rng = random.Random(11)
    rows = [(str(i), field(rng), field(rng)) for i in range(900)]
    rows[400] = ("400", "long\n" * 2000, "over many splits")
    written(tmp_path / "f.csv", rows)
    df = read(spark, tmp_path / "f.csv")
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "f.csv")).rdd.getNumPartitions() > 20
    assert sorted((r["a"], r["b"], r["c"]) for r in df.collect()) == sorted(rows)


def test_many_files_of_one_split_each(spark, tmp_path):
    rng = random.Random(12)
    want = []
    for n in range(5):
        rows = [(f"{n}-{i}", field(rng), field(rng)) for i in range(30)]
        written(tmp_path / f"f{n}.csv", rows)
        want += rows
    df = read(spark, tmp_path)
    assert sorted((r["a"], r["b"], r["c"]) for r in df.collect()) == sorted(want)
    assert df.select("_file").distinct().count() == 5


def test_without_the_broadcast_the_records_are_the_same(spark, small_splits, tmp_path, monkeypatch):
    from tonality.sources import csv_records as C
    rng = random.Random(13)
    rows = [(str(i), field(rng), field(rng)) for i in range(300)]
    written(tmp_path / "f.csv", rows)
    monkeypatch.setattr(C, "is_small", lambda df, n: False)
    assert sorted((r["a"], r["b"], r["c"]) for r in read(spark, tmp_path / "f.csv").collect()) == sorted(rows)


def test_broken_files_fail_and_empty_ones_have_no_rows(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('"a","b","c"\n"1","open,\n')
    with pytest.raises(Exception, match="not closed"):
        read(spark, tmp_path / "odd.csv").collect()
    (tmp_path / "other.csv").write_text('"a","c","b"\n"1","2","3"\n')
    with pytest.raises(Exception, match="another header"):
        read(spark, tmp_path / "other.csv").collect()
    (tmp_path / "few.csv").write_text('"a","b","c"\n\n"1",,"\\N"\n\n"2","",x')
    whole = spark.read.schema(SCHEMA).options(**CSV_READ_OPTIONS).csv(str(tmp_path / "few.csv"))
    got = sorted(map(repr, read(spark, tmp_path / "few.csv").select("a", "b", "c").collect()))
    assert got == sorted(map(repr, whole.collect())) and len(got) == 2
    (tmp_path / "empty.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "empty.csv")).count() == 0
