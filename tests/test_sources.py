"""File catalogue: headers without a job a file, months by name."""

import gzip

import pytest

from wattlens.sources import readers


def test_ten_thousand_small_files(spark, tmp_path):
    for i in range(10_000):
        head = "MRID\tValue" if i % 2 else "mRID\tVersion\tValue"
        (tmp_path / f"{2015 + i % 5}_{i % 12 + 1:02d}_{i}.csv").write_text(f"{head}\nM{i}\t{'1\t' if not i % 2 else ''}{i}\n")
    spark.sparkContext.setJobGroup("catalogue", "list and read headers")
    groups = readers.files_by_header(spark, [str(tmp_path)], "\t")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("catalogue"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3  # listing and names, none for a file
    assert sorted(map(len, groups)) == [5000, 5000]
    few = readers.files_by_header(spark, [str(tmp_path)], "\t", "2016-03-01", "2016-05-31 23:00:00")
    assert 0 < sum(map(len, few)) < 600 and all(readers.MONTH_IN_NAME.search(p)[0][:7] in ("2016_03", "2016_04", "2016_05") for g in few for p in g)


def test_headers_by_name_packed_files_and_months(spark, tmp_path):
    (tmp_path / "2020_01_a.csv").write_text('\ufeffa\t"b c"\n1\t2\n', encoding="utf-8")
    (tmp_path / "2020_02_b.csv").write_text("b c\td\n3\t4\n")
    with gzip.open(tmp_path / "2020_03_c.csv.gz", "wt") as f:
        f.write("d\n5\n")
    (tmp_path / "other.csv").write_text("d\n6\n")

    def rows(**k):
        d = readers.read_text_table(spark, str(tmp_path), **k)
        return sorted((tuple(r[c] for c in ("b c", "d")) for r in d.collect()), key=str)

    assert readers.header_of(spark, str(tmp_path / "2020_01_a.csv"), "\t") == ["a", "b c"]
    assert rows() == sorted([("2", None), ("3", "4"), (None, "5"), (None, "6")], key=str)
    assert rows(start="2020-02-01", end="2020-02-29") == sorted([("3", "4"), (None, "6")], key=str)
    with pytest.raises(FileNotFoundError):
        readers.read_text_table(spark, str(tmp_path / "2020_01_a.csv"), start="2021-01-01")
