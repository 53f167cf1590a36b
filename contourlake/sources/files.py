"""Point clouds, scalar functions, labels, domains, meshes and lists."""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import numbered
from .ranges import fixed_records, numbered_lines, read_at, write_records
from .structures import conformations, exists

POINTS, LABELS, FUNCTIONS, PROJECTS = "pcd_v3.dat", "secondary_structure_dssp.dat", "scalar_functions", "collab_projects"


def _matrix_rows(batches, d: int):
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">f4").astype(np.float32)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["conf_id", "v"])


def read_points(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """conf_id, v of a point-cloud file: big-endian count, dimension, then float32 rows. Tasks read byte ranges (``size`` bytes). The native form is a Parquet table of the same columns."""
    n, d = struct.unpack(">ii", read_at(path, 8))
    rows = fixed_records(spark, path, max(4 * d, 1), 8, size).filter(F.col("record_no") < n)
    return rows.mapInArrow(partial(_matrix_rows, d=d), "conf_id long, v array<float>")


def _matrix_bytes(batches):
    for batch in batches:
        flat = batch.column(1)
        content = [np.asarray(v, ">f4").tobytes() for v in flat.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["conf_id", "content"])


def write_points(points: DataFrame, path: str) -> None:
    """One file in the format of :func:`read_points`, for other programs, in the order of conf_id: tasks write parts, which are joined."""
    rows = points.select(F.col("conf_id").cast("long"), F.col("v").cast("array<float>")).mapInArrow(_matrix_bytes, "conf_id long, content binary")
    write_records(rows, [F.col("conf_id")], path, lambda n, length: struct.pack(">ii", n, length // 4))


def read_function(spark: SparkSession, path: str) -> DataFrame:
    """conf_id, f: one number on each line. A line that is no number raises."""
    return numbered_lines(spark, path).filter("trim(line) <> ''").select(F.col("line_no").cast("long").alias("conf_id"), F.trim("line").cast("float").alias("f"))


def function_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of all .txt files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_labels(spark: SparkSession, path: str, n_residues: int, size: int | None = None) -> DataFrame:
    """conf_id, res_idx, label of a file of label characters (one byte each), n_residues for each structure. Tasks read byte ranges (``size`` bytes)."""
    rows = fixed_records(spark, path, n_residues, size=size)
    own = F.filter(F.split(F.decode("content", "ISO-8859-1"), ""), lambda c: c != "")
    return rows.select(F.col("record_no").alias("conf_id"), F.posexplode(own).alias("res_idx", "label"))


def labels_at(spark: SparkSession, path: str | None, n_residues: int, place: int, conf_id: int) -> DataFrame:
    """conf_id, res_idx, label of the structure at a place of the file, named ``conf_id``: one read of its bytes. No rows without a file or beyond its end."""
    text = read_at(path, n_residues, place * n_residues).decode("latin-1") if path and place >= 0 else ""
    return spark.createDataFrame([(conf_id, i, c) for i, c in enumerate(text)], "conf_id long, res_idx int, label string")


def write_labels(labels: DataFrame, path: str) -> None:
    """One file of labels(conf_id, text), texts of one length, in the order of conf_id."""
    write_records(labels.select("conf_id", F.encode("text", "ISO-8859-1").alias("content")), [F.col("conf_id")], path)


def labels_of(labels: DataFrame, conf_id: int, n_residues: int) -> DataFrame:
    """res_idx, label of one structure; 'X' where there is none."""
    every = labels.sparkSession.range(n_residues).select(F.col("id").cast("int").alias("res_idx"))
    own = labels.filter(F.col("conf_id") == conf_id).select("res_idx", "label")
    return every.join(own, "res_idx", "left").select("res_idx", F.coalesce("label", F.lit("X")).alias("label"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lines of a white or black list."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''").distinct()


def write_domain(edges: DataFrame, sample: DataFrame, folder: str) -> None:
    edges.select("src", "dst").write.mode("overwrite").parquet(f"{folder}/edges")
    sample.select("s_id", "conf_id").write.mode("overwrite").parquet(f"{folder}/sample_map")


def read_domain(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/sample_map")


def _binary_domain(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack(">i", content[:4])[0]
    pairs = np.frombuffer(content, ">i4", 2 * n, 4).reshape(n, 2)
    m = struct.unpack(">i", content[4 + 8 * n : 8 + 8 * n])[0]
    return pairs, np.frombuffer(content, ">i4", m, 8 + 8 * n)


def read_binary_domain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst), sample_map(s_id, conf_id)) of a domain file: big-endian edge count, pairs, sample size, ids."""

    def edges(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                pairs = _binary_domain(content)[0].astype(np.int32)
                yield pd.DataFrame({"src": pairs.min(axis=1), "dst": pairs.max(axis=1)})

    def sample(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                ids = _binary_domain(content)[1].astype(np.int64)
                yield pd.DataFrame({"s_id": np.arange(len(ids), dtype=np.int32), "conf_id": ids})

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(edges, "src int, dst int").filter("src <> dst").distinct(), raw.mapInPandas(sample, "s_id int, conf_id long")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(v, xyz), faces(face_id, v)) of an OBJ text; indices from 1 become indices from 0."""
    lines = numbered_lines(spark, path).select("line_no", F.split(F.trim("line"), r"\s+").alias("w"))
    rest = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    vertices = numbered(lines.filter("w[0] = 'v'"), [F.col("line_no")], "v").select("v", F.transform(rest, lambda x: x.cast("double")).alias("xyz"))
    faces = numbered(lines.filter("w[0] IN ('e', 'f')"), [F.col("line_no")], "face_id").select("face_id", F.transform(rest, lambda x: F.split(x, "/")[0].cast("int") - 1).alias("v"))
    return vertices, faces


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(v, xyz), faces(face_id, v)) of an OFF text; blank lines and comments are skipped."""
    lines = numbered_lines(spark, path).filter("trim(line) <> '' AND NOT trim(line) LIKE '#%'").select("line_no", F.split(F.trim("line"), r"\s+").alias("w"))
    lines = numbered(lines, [F.col("line_no")], "at", kind="long")
    counts = lines.filter("at = 1").select("w").first()["w"]
    n, m = int(counts[0]), int(counts[1])
    # Only a part's own lines are read as numbers, wherever the optimiser puts the filters.
    part = lambda first, size: F.when((F.col("at") >= first) & (F.col("at") < first + size), F.col("w"))
    points, sides = part(2, n), part(2 + n, m)
    vertices = lines.filter(points.isNotNull()).select((F.col("at") - 2).cast("int").alias("v"), F.transform(points, lambda x: x.cast("double")).alias("xyz"))
    faces = lines.filter(sides.isNotNull()).select((F.col("at") - 2 - n).cast("int").alias("face_id"), F.transform(F.slice(sides, F.lit(2), F.get(sides, F.lit(0)).cast("int")), lambda x: x.cast("int")).alias("v"))
    return vertices, faces


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """part, at, line of an OBJ text, to be written in the order of (part, at)."""
    text = lambda a, first: F.concat_ws(" ", F.lit(first), F.array_join(F.transform(a, lambda x: x.cast("string")), " "))
    v = vertices.select(F.lit(0).alias("part"), F.col("v").alias("at"), text(F.col("xyz"), "v").alias("line"))
    kind = F.when(F.size("v") == 2, "e").otherwise("f")
    f = faces.select(F.lit(1).alias("part"), F.col("face_id").alias("at"), F.concat_ws(" ", kind, F.array_join(F.transform("v", lambda x: (x + 1).cast("string")), " ")).alias("line"))
    return v.unionByName(f)


def off_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """part, at, line of an OFF text, to be written in the order of (part, at)."""
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, 0, "OFF")], "part int, at int, line string")
    sizes = vertices.agg(F.count(F.lit(1)).alias("n")).crossJoin(faces.agg(F.count(F.lit(1)).alias("m")))  # one row each
    sizes = sizes.select(F.lit(1).alias("part"), F.lit(0).alias("at"), F.concat_ws(" ", "n", "m", F.lit("0")).alias("line"))
    v = vertices.select(F.lit(2).alias("part"), F.col("v").alias("at"), F.array_join(F.transform("xyz", lambda x: x.cast("string")), " ").alias("line"))
    f = faces.select(F.lit(3).alias("part"), F.col("face_id").alias("at"), F.concat_ws(" ", F.size("v"), F.array_join(F.transform("v", lambda x: x.cast("string")), " ")).alias("line"))
    return head.unionByName(sizes).unionByName(v).unionByName(f)


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("part", "at")) -> None:
    """A folder with one text file of lines(line) in an order; tasks write parts, which are joined."""
    rows = lines.select(*order, F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("content"))
    write_records(rows, [F.col(c) for c in order], f"{path}/part-00000.txt")


def open_dataset(spark: SparkSession, dataset: str) -> dict:
    """The parts of a dataset, checked in order; points and functions are needed, labels are not."""
    if not exists(spark, dataset):
        raise FileNotFoundError(dataset)
    parts = {"conformations": conformations(spark, dataset)}
    for name in (POINTS, FUNCTIONS):
        if not exists(spark, f"{dataset}/{name}"):
            raise FileNotFoundError(f"{dataset} lacks {name}")
    parts["points"] = read_points(spark, f"{dataset}/{POINTS}")
    parts["functions"] = function_files(spark, f"{dataset}/{FUNCTIONS}")
    parts["labels"] = f"{dataset}/{LABELS}" if exists(spark, f"{dataset}/{LABELS}") else None
    return parts


def catalog(spark: SparkSession, root: str, below: str = PROJECTS) -> DataFrame:
    """dataset, names: what lies in ``<root>/<dataset>/<below>``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for entry in fs.listStatus(path):
        inner = hadoop.Path(entry.getPath(), below)
        if entry.isDirectory() and fs.exists(inner):
            rows += [(entry.getPath().getName(), x.getPath().getName()) for x in fs.listStatus(inner)]
    found = spark.createDataFrame(rows, "dataset string, name string")
    return found.groupBy("dataset").agg(F.sort_array(F.collect_list("name")).alias("names"))
