"""Single files in several tasks: ranges, archive entries, line numbers and joined parts."""

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.sources import files, ranges, structures


def partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_records_of_ranges(spark, tmp_path):
    data = bytes(range(256)) * 5
    (tmp_path / "x.dat").write_bytes(b"head" + data)
    df = ranges.fixed_records(spark, str(tmp_path / "x.dat"), 7, 4, size=100)
    got = sorted((r["record_no"], bytes(r["content"])) for r in df.collect())
    assert [c for _, c in got] == [data[i : i + 7] for i in range(0, len(data), 7)] and [i for i, _ in got] == list(range(len(got)))
    assert partitions(df) > 10
    (tmp_path / "empty.dat").write_bytes(b"head")
    assert ranges.fixed_records(spark, str(tmp_path / "empty.dat"), 7, 4).isEmpty()


def test_points_in_parts(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(300, 5)).astype(np.float32)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "conf_id long, v array<float>").repartition(6)
    files.write_points(df, str(tmp_path / "p.dat"))
    assert (tmp_path / "p.dat").read_bytes() == struct.pack(">ii", 300, 5) + x.astype(">f4").tobytes()
    back = files.read_points(spark, f"file:{tmp_path}/p.dat", size=1000)
    assert partitions(back) > 3
    assert [r["v"] for r in back.orderBy("conf_id").collect()] == x.tolist()
    files.write_points(df.limit(0), str(tmp_path / "none.dat"))
    assert files.read_points(spark, str(tmp_path / "none.dat")).isEmpty()


def test_entries_of_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / structures.ZIP_NAME, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"d/{i}.pdb", "".join(f"ATOM {i} {j}\r\n" for j in range(i % 5 + 1)))
    (tmp_path / structures.ZIP_LIST).write_text("".join(f"d/{i}.pdb\n" for i in reversed(range(40))))
    df = ranges.zip_entries(spark, str(tmp_path / structures.ZIP_NAME), entries=7)
    assert partitions(df) >= 4 and {r["path"] for r in df.collect()} == {f"d/{i}.pdb" for i in range(40)}
    lines = structures.structure_lines(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, lines)) == sorted((39 - i, f"d/{i}.pdb", j, f"ATOM {i} {j}") for i in range(40) for j in range(i % 5 + 1))
    assert len(structures.one_structure(spark, str(tmp_path), 0).collect()) == 5


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_numbers_across_splits(spark, tmp_path, end):
    lines = [f"{i} {'x' * (i % 50)}" for i in range(5000)]
    lines[17] = lines[18] = ""
    (tmp_path / "t.txt").write_bytes(end.join(lines).encode())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k"), spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert spark.read.text(str(tmp_path / "t.txt")).rdd.getNumPartitions() > 5
        got = ranges.numbered_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == list(enumerate(lines))


def test_lines_in_parts(spark, tmp_path):
    df = spark.range(1000).select(F.lit(0).alias("part"), (-F.col("id")).alias("at"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("line")).repartition(7)
    files.write_lines(df, str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt" / "part-00000.txt").read_text() == "".join(f"é{i}\n" for i in reversed(range(1000)))
    wide = " ".join(str(i) for i in range(30))
    (tmp_path / "w.obj").write_text(f"v {wide}\nf 1 2 3\n")
    assert len(files.read_obj(spark, str(tmp_path / "w.obj"))[0].first()["xyz"]) == 30
