"""CSV files with line breaks in cells, in several splits, against Python's reader."""

import csv
import random

import pytest

from tidemill.sources import tables


def cells(rng):
    return rng.choice(["plain", "", "with, comma", 'said "no"', "two\nlines", '"\n"', "\n\n", "x" * 200, 'a\n"b", c\nd', "é\nü"])


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_cells_with_line_breaks_in_splits(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for k in range(3):
        with open(tmp_path / f"part{k}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if k == 1 else "\n")
            out.writerow(["id", 'odd\nname "x"', "number"])
            for i in range(60):
                row = [f"{k}-{i}", cells(rng), rng.choice(["1", "22", "", "-3"])]
                out.writerow(row)
                want.append(tuple(v or None for v in row[:2]) + (int(row[2]) if row[2] else None,))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = tables.read_csv(spark, str(tmp_path / "*.csv"))
        assert got.columns == ["id", 'odd\nname "x"', "number"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        if size < 1000:
            assert tables._csv_lines(spark, str(tmp_path / "*.csv")).select("file", "start").distinct().count() > 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_without_breaks_and_a_stated_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"a, b"\n2,\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [(1, "a, b"), (2, None)]
    (tmp_path / "b.csv").write_text('id,note\n1,"a\nb"\n2,\n')
    stated = tables.read_csv(spark, str(tmp_path / "b.csv"), "id long, note string")
    assert [tuple(r) for r in stated.orderBy("id").collect()] == [(1, "a\nb"), (2, None)]
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "b.csv"), multi_line=True).orderBy("id").collect()] == [(1, "a\nb"), (2, None)]
