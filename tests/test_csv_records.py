"""CSV records found by several tasks in one file, against Spark's own reader and the csv module."""

import csv
import io
import random

import pytest

from matchloom.sources import csv as cs

HEADER = ["ID", "Resume_str", "Resume_html", "Category"]
PIECES = ["word", ",", '"', "\n", "\r\n", "\n\n", " ", "é", '<p class="x">', "", "Straße", '""', "1,5"]


def rows_of(rng, n):
    def cell():
        return "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14)))

    return [[f"r{k}", cell() + "x", cell(), rng.choice(["hr", "it", ""])] for k in range(n)]


def write(path, rows, end="\n"):
    buf = io.StringIO()
    out = csv.writer(buf, lineterminator=end)
    out.writerow(HEADER)
    out.writerows(rows)
    path.write_bytes(buf.getvalue().encode())


@pytest.fixture
def small_splits(spark):
    """Splits of about 2 kB, so that records and quoted values run over their ends."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(df):
    return [tuple(r) for r in df.orderBy("seq").select("ID", "Resume_str", "Resume_html", "Category").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_many_tasks(spark, small_splits, tmp_path, end):
    rows = rows_of(random.Random(3), 1500)
    rows[700][1] = "a very long value\n" * 2000  # over a dozen splits and more
    path = tmp_path / "resumes.csv"
    write(path, rows, end)
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 20
    got = cells(cs._read(spark, str(path), cs.RESUME))
    assert got == [(a, b, c or None, d or None) for a, b, c, d in rows]
    seqs = [r.seq for r in cs._read(spark, str(path), cs.RESUME).select("seq").orderBy("seq").collect()]
    assert seqs == list(range(2, 1502))  # the header has number 1


def test_same_as_the_plain_reader(spark, small_splits, tmp_path):
    for k in range(3):
        write(tmp_path / f"part-{k}.csv", rows_of(random.Random(k), 200))
    (tmp_path / "part-3.csv").write_text('ID,Resume_str,Resume_html,Category\n')
    (tmp_path / "part-4.csv").write_text('\nID,Resume_str,Resume_html,Category\n\na,"b ""c"", d",,\n\nx,,"",z')
    both = [sorted(map(repr, cells(cs._read(spark, str(tmp_path), cs.RESUME, split)))) for split in (True, False)]
    assert len(both[0]) == 602 and both[0] == both[1]


def test_limit_takes_the_first_of_the_file(spark, small_splits, tmp_path):
    rows = rows_of(random.Random(9), 900)
    write(tmp_path / "r.csv", rows)
    got = cs.read_resumes(spark, str(tmp_path / "r.csv"), 333)
    assert sorted(r.raw_id for r in got.collect()) == sorted(r[0] for r in rows[:333])


@pytest.mark.parametrize("line", ['a,5" disk,,hr', 'a,"b" c,,hr', 'a,"never closed,,hr'])
def test_stray_quotes_are_refused(spark, tmp_path, line):
    (tmp_path / "r.csv").write_text(",".join(HEADER) + f"\nz,y,x,w\n{line}\nb,c,d,e\n")
    with pytest.raises(Exception, match="a quote that neither begins nor ends a value"):
        cs.read_resumes(spark, str(tmp_path / "r.csv")).collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("")
    assert cs.read_resumes(spark, str(tmp_path / "r.csv")).collect() == []
