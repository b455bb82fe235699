"""Exports that several tasks read: quoted line breaks, commas, doubled quotes, across file splits."""

import csv
import random

import pytest

from stocktide.sources.files import _line_patterns, scan_export


def plain_rows(path, sep):
    with open(path, newline="", encoding="utf-8") as f:
        rows = [r for r in csv.reader(f, delimiter=sep) if any(c.strip() for c in r)]
    return [tuple(" ".join(c.split()) for c in r) for r in rows[1:]]


def cell(rng):
    kind = rng.randrange(8)
    if kind == 0:
        return 'in "quotes", twice'
    if kind == 1:
        return "two\nlines" if rng.random() < 0.5 else 'three\n"quoted"\n\nlines;|'
    if kind == 2:
        return ""
    return "".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 40))).strip()


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_rows_of_a_split_file_equal_a_plain_reader(spark, tmp_path, sep):
    rng = random.Random(3)
    path = tmp_path / "export.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("\n\n")
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(["CODE", "NAME", "NOTE", "PLACE"])
        for k in range(600):
            out.writerow([f"k{k}", cell(rng), cell(rng), cell(rng)])
        out.writerow(["last", "a very long value " + "\n".join("x" * 90 for _ in range(120)), "", ""])
        out.writerow(["end", "", "", ""])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # a value of several splits too
        got = scan_export(spark, [str(path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.source_block for r in got}) > 5
    got.sort(key=lambda r: (r.source_block, r.source_row_number))
    squeezed = [tuple(" ".join((v or "").split()) for v in (r.CODE, r.NAME, r.NOTE, r.PLACE)) for r in got]
    assert squeezed == plain_rows(path, sep)


def test_a_file_without_line_breaks_is_split_by_the_reader(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("\nCODE,SIZE\n" + "".join(f'k{k},5" pipe\n"q{k}","a ""b"", c"\n' for k in range(400)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        df = scan_export(spark, [str(path)])
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 800
    assert {r.SIZE for r in got} == {'5" pipe', 'a "b", c'}


def test_line_patterns():
    import re
    outside, inside = _line_patterns(",")
    for line, ends_out in (("a,b", True), ('a,"b', False), ('a,"b"', True), ('a,"b""', False), ('5" x,b', True), ('"a ""b"" c",d', True), ("", True)):
        assert bool(re.search(outside, line)) is ends_out, line
    for line, ends_out in (("a,b", False), ('a",b', True), ('a""b', False), ('a","b', False), ('a","b"', True), ('"', True)):
        assert bool(re.search(inside, line)) is ends_out, line
