"""Splittable CSV against the csv module and Spark's one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from utterscope.sources.csv_split import LineStates, read_split_csv, split_records

NAMES = ["id", "text", "note"]
SCHEMA = StructType([StructField(n, StringType()) for n in NAMES])


def some_rows(n, seed):
    rng = random.Random(seed)
    pieces = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "\n\n", '"', '""', "é 日本", "x;y", "end\n", " sp ", "1" * 60]
    return [[str(i), "".join(rng.choice(pieces) for _ in range(rng.randrange(5))) or "-", rng.choice(["n", "a\nb", 'q"'])]
            for i in range(n)]


def written(tmp_path, rows, sep=",", end="\n", name="in.csv"):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(NAMES)
    w.writerows(rows)
    path = tmp_path / name
    path.write_bytes(out.getvalue().encode())
    return str(path)


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, one to a task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "300")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\r\n")])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, sep, end):
    rows = some_rows(150, 1)
    path = written(tmp_path, rows, sep, end)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    got = read_split_csv(spark, path, SCHEMA, sep)
    assert sorted(map(list, got.collect())) == sorted(rows)
    whole = spark.read.schema(SCHEMA).option("header", True).option("sep", sep).option("multiLine", True).option(
        "escape", '"').option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", False).csv(path)
    assert sorted(map(list, whole.collect())) == sorted(map(list, got.collect()))


def test_a_record_longer_than_several_splits(spark, tmp_path, small_splits):
    rows = [["1", "x"], ["2", "line of text\n" * 300], ["3", 'quote " and\n' * 100], ["4", "y"]]
    rows = [[*r, "n"] for r in rows]
    got = read_split_csv(spark, written(tmp_path, rows), SCHEMA)
    assert sorted(map(list, got.collect())) == sorted(rows)


def test_several_files_each_with_a_header(spark, tmp_path, small_splits):
    a, b = some_rows(40, 2), some_rows(30, 3)
    written(tmp_path, a, name="a.csv")
    written(tmp_path, b, name="b.csv")
    assert sorted(map(list, read_split_csv(spark, str(tmp_path), SCHEMA).collect())) == sorted(a + b)


def test_header_only_and_empty_lines(spark, tmp_path):
    assert read_split_csv(spark, written(tmp_path, []), SCHEMA).collect() == []
    path = tmp_path / "gaps.csv"
    path.write_text('id,text,note\n\n1,a,b\n\n\n2,"c\n\nd",e\n')
    assert sorted(map(tuple, read_split_csv(spark, str(path), SCHEMA).collect())) == [("1", "a", "b"), ("2", "c\n\nd", "e")]
    assert [r.record for r in split_records(spark, str(path), ",").orderBy("start", "nth").collect()][0] == "1,a,b"


def test_quotes_inside_unquoted_fields_open_nothing(spark, tmp_path):
    path = tmp_path / "inch.csv"
    path.write_text('id,text,note\n1,a 5" screen,b\n2,"x",y "z"\n')
    assert sorted(r.id for r in read_split_csv(spark, str(path), SCHEMA).collect()) == ["1", "2"]


def test_line_states_equal_a_character_machine():
    def plain(line, inside):
        at_start, k = not inside, 0
        while k < len(line):
            c = line[k]
            if inside:
                if c == '"':
                    if line[k + 1:k + 2] == '"':
                        k += 1
                    else:
                        inside, at_start = False, False
            elif c == ",":
                at_start = True
            elif c == '"' and at_start:
                inside, at_start = True, False
            else:
                at_start = False
            k += 1
        return inside

    rng = random.Random(5)
    states = LineStates(",")
    for _ in range(20_000):
        line = "".join(rng.choice('",a ') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            assert states.inside_after(line, inside) == plain(line, inside), (line, inside)
