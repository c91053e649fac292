"""CSV files in byte ranges against Python's own reader of the whole file."""

import csv
import io
import random
from contextlib import contextmanager

import pytest

from assurelake.sources import ingest, quoted_csv
from assurelake.sources.catalog import Catalog


@contextmanager
def ranges_of(spark, size):
    """Ranges of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def got(spark, path):
    s = quoted_csv.scan(spark, str(path))
    rows = s.records().orderBy("_row").collect()
    assert [r["_row"] for r in rows] == list(range(1, len(rows) + 1)) and s.total == len(rows)
    return s, [tuple(r)[:-1] for r in rows]


def want(text):
    blanks = "".join(map(chr, range(33)))
    rows = [[v.strip(blanks) for v in r] for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    return [tuple(r[: len(rows[0])]) for r in rows[1:]]


def made(rng, n, end):
    """Records with breaks, quotes, commas, stray quotes, empty lines and long values."""
    pieces = ["a", '""', "\n", "\r\n", ",", " ", "é", "x" * 30, '"",""', "\n\n", "\r"]
    out = ["id,b,c" + end]
    for i in range(n):
        quoted = ['"' + "".join(rng.choices(pieces, k=rng.randint(0, 6))) + '"' + rng.choice(["", " "]) for _ in range(2)]
        plain = [rng.choice(['q"r', "", " plain ", 'a""', "5\" pipe"]) for _ in range(2)]
        out.append(",".join([str(i), *(rng.choice(p) for p in zip(quoted, plain, strict=True)), *rng.choice([[], ["more"]])]) + end)
        out.append(rng.choice(["", "", end]))
    return "".join(out)


@pytest.mark.parametrize("seed,size,end", [(1, 64, "\n"), (2, 200, "\r\n"), (3, 1000, "\n"), (4, 1 << 20, "\r"), (5, 333, "\r\n"), (6, 64, "\r\n")])
def test_records_are_those_of_the_whole_file(spark, tmp_path, seed, size, end):
    text = made(random.Random(seed), 150, end)
    path = tmp_path / "f.csv"
    path.write_text(text, newline="")
    with ranges_of(spark, size):
        s, rows = got(spark, path)
    assert s.columns == ["id", "b", "c"] and rows == want(text)
    assert (len(s.begins) > 10) == (size < 500)
    with ranges_of(spark, 5000):
        assert quoted_csv.scan(spark, str(path)).digest == s.digest  # however the file is split
    path.write_text(text.replace("plain", "plaim", 1), newline="")
    assert quoted_csv.scan(spark, str(path)).digest != s.digest


def test_a_record_over_many_ranges(spark, tmp_path):
    big = "\n".join(f'line {i} ""q"", ' for i in range(400))
    text = f'﻿k,"v\nw"\n1,"{big}"\n2,short\n3,"{big}"'
    (tmp_path / "f.csv").write_text(text)
    with ranges_of(spark, 300):
        s, rows = got(spark, tmp_path / "f.csv")
    assert s.columns == ["k", "v\nw"] and len(s.begins) > 20
    assert rows == want(text) and rows[0][1].count("\n") == 399


def test_headers_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x, Y ,x\n1,2,3\n\n"4\n",5,6\n')
    (tmp_path / "b.csv").write_text("x, Y ,x\n7,8,9\n")
    s, rows = got(spark, tmp_path)
    assert s.columns == ["x", "Y"] and rows == [("3", "2"), ("6", "5"), ("9", "8")]
    for name, text in {"empty": "", "header": "a,b\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
        assert got(spark, tmp_path / f"{name}.csv")[1] == []


@pytest.mark.parametrize("text", ["a,b\n1\n", 'a,b\n1,"open\n2,3\n', 'a,b\n"x"y,2\n', "a,,c\n1,2,3\n", 'a,b\n"1\n2"\n'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    job = ingest.ingest(spark, str(tmp_path / "f.csv"), "taxpayers", "s", "j", "2024-01-01 00:00:00", Catalog(spark, f"file://{tmp_path}/c"))
    assert job["status"] == "FAILED" and job["error"]


def test_ingest_breaks_lengths_and_duplicates(spark, tmp_path):
    rows = ["kra_pin,taxpayer_type,legal_name,status"]
    rows += [f'K{i},COMPANY,"Name {i}\nof ""{i}"", limited",ACTIVE' for i in range(40)]
    rows += [f"L1,COMPANY,{'n' * 240},ACTIVE", f"L2,COMPANY,{'n' * 241},ACTIVE", f"{'p' * 41},COMPANY,n,ACTIVE"]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(rows) + "\n")
    cat = Catalog(spark, f"file://{tmp_path}/c")
    with ranges_of(spark, 100):
        job = ingest.ingest(spark, str(path), "taxpayers", "s", "j", "2024-01-01 00:00:00", cat)
    assert (job["status"], job["total"], job["valid"], job["invalid"]) == ("COMPLETED_WITH_ERRORS", 43, 41, 2)
    assert {r.legal_name for r in cat.read("taxpayers").filter("kra_pin LIKE 'K%'").collect()} == {f'Name {i}\nof "{i}", limited' for i in range(40)}
    assert sorted((r.record_reference, r.field, r.code) for r in cat.read("data_quality_issues").collect()) == [("L2", None, "PERSISTENCE_ERROR"), ("p" * 41, None, "PERSISTENCE_ERROR")]
    jobs = spark.createDataFrame([("s", "taxpayers", job["file_hash"], job["status"])], "source string, table_name string, file_hash string, status string")
    assert ingest.ingest(spark, str(path), "taxpayers", "s", "j2", "2024-01-01 00:00:00", cat, jobs)["status"] == "DUPLICATE"
