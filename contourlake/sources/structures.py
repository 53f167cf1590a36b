"""Structure files: fixed-width atom lines, from folders or from zip archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import numbered_lines, zip_entries

ZIP_NAME, ZIP_LIST, FILE_LIST = "conformations.zip", "conformation_zip_paths.txt", "conformation_filenames.txt"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def conformations(spark: SparkSession, dataset: str) -> DataFrame:
    """conf_id, path and the kind of source ("zip" wins over "file"). Raises if the dataset has neither."""
    if exists(spark, f"{dataset}/{ZIP_NAME}") and exists(spark, f"{dataset}/{ZIP_LIST}"):
        kind, listing = "zip", f"{dataset}/{ZIP_LIST}"
    elif exists(spark, f"{dataset}/{FILE_LIST}"):
        kind, listing = "file", f"{dataset}/{FILE_LIST}"
    else:
        raise FileNotFoundError(f"{dataset} has neither {ZIP_NAME} with {ZIP_LIST} nor {FILE_LIST}")
    return numbered_lines(spark, listing).filter("trim(line) <> ''").select(F.col("line_no").cast("long").alias("conf_id"), F.trim("line").alias("path"), F.lit(kind).alias("kind"))


def _text_lines(content: Column) -> Column:
    """The lines of a file's bytes."""
    return F.split(F.regexp_replace(F.decode(content, "UTF-8"), r"\r?\n\z", ""), r"\r?\n")


def structure_lines(spark: SparkSession, dataset: str) -> DataFrame:
    """conf_id, path, line_no, line of all structures of a dataset."""
    listed = conformations(spark, dataset)
    kind = listed.select("kind").first()
    if kind is None or kind[0] == "zip":
        own = zip_entries(spark, f"{dataset}/{ZIP_NAME}").join(listed.select("conf_id", "path"), "path")
        return own.select("conf_id", "path", F.posexplode(_text_lines(F.col("content"))).alias("line_no", "line"))
    # Listed paths may be relative to the dataset.
    paths = listed.withColumn("file", F.when(F.col("path").rlike("^(/|[a-z]+:)"), F.col("path")).otherwise(F.concat(F.lit(f"{dataset}/"), F.col("path"))))
    texts = spark.read.text(dataset, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("file"), "value")
    own = paths.withColumn("file", F.regexp_replace("file", "^file:/*", "/")).join(texts, "file")
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    return own.select("conf_id", "path", F.posexplode(lines).alias("line_no", "line"))


def one_structure(spark: SparkSession, dataset: str, conf_id: int) -> DataFrame:
    """conf_id, path, line_no, line of one structure: only its archive entry is unpacked, or only its file is read. No rows if it is not listed or has no file."""
    row = conformations(spark, dataset).filter(F.col("conf_id") == conf_id).first()
    own = [F.lit(conf_id).cast("long").alias("conf_id"), F.lit(row["path"] if row else "").alias("path")]
    if row and row["kind"] == "zip":
        found = zip_entries(spark, f"{dataset}/{ZIP_NAME}", name=row["path"])
        return found.select(*own, F.posexplode(_text_lines(F.col("content"))).alias("line_no", "line"))
    file = row and (row["path"] if re.match(r"/|[a-z]+:", row["path"]) else f"{dataset}/{row['path']}")
    if not file or not exists(spark, file):
        return spark.createDataFrame([], "conf_id long, path string, line_no int, line string")
    # A listed name is no pattern; a structure is small, so its file is one row.
    text = spark.read.text(re.sub(r"([\[\]{}*?\\])", r"\\\1", file), wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    return text.select(*own, F.posexplode(lines).alias("line_no", "line"))


def is_atom(line: Column) -> Column:
    return line.startswith("ATOM")


def backbone(lines: DataFrame) -> DataFrame:
    """lines(conf_id, line_no, line) -> conf_id, res_idx, x, y, z: the alpha carbons in file order, res_idx from 0."""
    from pyspark.sql.window import Window

    line = F.col("line")
    place = lambda at, n: F.trim(F.substring(line, at, n)).cast("float")
    atoms = lines.filter(is_atom(line) & (F.trim(F.substring(line, 12, 6)) == "CA"))
    order = Window.partitionBy("conf_id").orderBy("line_no")
    return atoms.select("conf_id", (F.row_number().over(order) - 1).alias("res_idx"), place(27, 12).alias("x"), place(39, 8).alias("y"), place(47, 8).alias("z"))


def residue_counts(lines: DataFrame) -> DataFrame:
    """conf_id, n_residues: the residue number of the last atom line."""
    atoms = lines.filter(is_atom(F.col("line")))
    return atoms.groupBy("conf_id").agg(F.max_by(F.trim(F.substring("line", 23, 5)).cast("int"), "line_no").alias("n_residues"))
