"""CSV rows that do not fit, and files read by many tasks."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from termpulse.sources import posts as src


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


BROKEN = 'content,date,label\n"fine, row",2020-01-01,1\nbroken, row, 2020-01-02,0\nshort,2020-01-03\nlast,2020-01-04,0\n'


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("split", [True, False])
def test_a_row_with_too_many_fields_fails(spark, tmp_path, multi_line, split):
    write(tmp_path, "a.csv", BROKEN)
    read = src.read_custom_posts(spark, str(tmp_path), multi_line, split=split)
    for action in (read.count, read.collect, read.select("date").collect):
        with pytest.raises(PySparkException, match="more fields than the header"):
            action()


@pytest.mark.parametrize("multi_line", [True, False])
def test_rejected_rows_are_kept_aside(spark, tmp_path, multi_line):
    write(tmp_path, "a.csv", BROKEN)
    found = src.read_custom_posts(spark, str(tmp_path), multi_line, malformed="drop").orderBy("id").collect()
    assert [(r.id, r.content, r.date, r.label) for r in found] == [
        (1, "fine, row", "2020-01-01", 1), (2, "short", "2020-01-03", None), (3, "last", "2020-01-04", 0),
    ]
    bad = src.rejected_rows(spark, str(tmp_path), multi_line).collect()
    assert [(r.record.strip(), r.n_fields, r.fault) for r in bad] == [("broken, row, 2020-01-02,0", 4, "more fields than the header")]
    with pytest.raises(ValueError):
        src.read_custom_posts(spark, str(tmp_path), malformed="mend")


def test_labelled_and_gbk_files_fail_too(spark, tmp_path):
    write(tmp_path, "a.csv", "text,label,label_name,date\na,1,happy,2020-01-01,extra\n")
    with pytest.raises(PySparkException, match="more fields"):
        src.read_labelled_posts(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "gbk").mkdir()
    write(tmp_path / "gbk", "b.csv", "content,date\n天气,2020-01-01,又\n北京,2020-01-02\n", "gbk")
    with pytest.raises(PySparkException, match="more fields"):
        src.read_custom_posts(spark, str(tmp_path / "gbk")).collect()
    kept = src.read_custom_posts(spark, str(tmp_path / "gbk"), malformed="drop").collect()
    assert [r.content for r in kept] == ["北京"]


def test_fields_are_counted_as_the_format_has_them(values):
    texts = ["a,b", '"a,b",c', '"a ""x"", b",c,d', ",", "", 'a"b,c', '"a\nb",c', '"",""']
    assert values(texts, src._fields(F.col("x"))) == [2, 2, 3, 2, 1, 2, 2, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_files_read_by_many_tasks_give_the_rows_of_one(spark, tmp_path, seed):
    rng = random.Random(seed)

    def field(k):
        kind = rng.random()
        if kind < 0.3:
            return f"plain {k}"
        if kind < 0.4:
            return ""
        inner = rng.choice(["line\nbreak", "comma, ", 'a ""quoted"" word', "\n\n", "x" * 200, "天气\n", "\r\nend"]) * rng.randint(1, 12)
        return f'"{inner}{k}"'

    for name, n in (("a.csv", 300), ("b.csv", 5), ("c.csv", 200)):
        end = rng.choice(["\n", "\r\n"])
        rows = [f"{field(k)},2020-01-{k % 28 + 1:02},{rng.choice(['0', '1', ''])}" for k in range(n)]
        rows[-1] = "plain,2020-03-01,1"
        rows[n // 2] = '"' + "a long field\n" * 400 + '",2020-02-02,1'
        write(tmp_path, name, "﻿" * (name == "b.csv") + end.join(["content,date,label", *rows[:3], "", *rows[3:]]) + rng.choice(["", end]))
    one = src.read_custom_posts(spark, str(tmp_path), utf8=True).orderBy("id").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        many = src.read_custom_posts(spark, str(tmp_path), utf8=True, split=True)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        found = many.orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(a, b) for a, b in zip(found, one) if a != b][:3] == []
    assert len(found) == len(one) == 505


def test_split_files_must_share_one_header(spark, tmp_path):
    write(tmp_path, "a.csv", "content,date\na,2020-01-01\n")
    write(tmp_path, "b.csv", "date,content\n2020-01-01,b\n")
    with pytest.raises(PySparkException, match="another header"):
        src.read_custom_posts(spark, str(tmp_path), utf8=True, split=True).collect()
