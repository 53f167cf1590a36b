"""Command line: ``points DATASET`` makes the point cloud of a dataset, ``domain [-w FILE | -b FILE] K DATASET NAME`` its neighbour graph."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pairwise_distances
from ..operators import linalg, neighbours
from ..operators.common import cut
from ..sources import files, structures


def distance_vectors(spark: SparkSession, dataset: str) -> DataFrame:
    """conf_id, v: the pairwise distances of each structure's backbone."""
    atoms = structures.backbone(structures.structure_lines(spark, dataset))
    whole = atoms.groupBy("conf_id").agg(F.array_sort(F.collect_list(F.struct("res_idx", "x", "y", "z"))).alias("b"))
    return whole.select("conf_id", pairwise_distances(F.col("b")).alias("v"))


def make_points(spark: SparkSession, dataset: str, components: int = 500, sample: int = 3000) -> DataFrame:
    """The point cloud, written to the dataset. Rows of its file are told apart by their place, so structures of different lengths raise."""
    vectors = cut(distance_vectors(spark, dataset), "vectors")
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy("n").limit(2).collect()
    if len(lengths) != 1 or not lengths[0]["n"]:
        raise ValueError(f"{dataset} has backbones of {len(lengths)} lengths; all need one, of two atoms or more")
    points = cut(linalg.point_cloud(vectors, components, sample), "points")
    files.write_points(points, f"{dataset}/{files.POINTS}")
    return points


def make_domain(spark: SparkSession, dataset: str, name: str, k: int, white: str | None = None, black: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph and the sample of a project, written to the dataset."""
    names = files.read_names(spark, white or black) if white or black else None
    parts = files.open_dataset(spark, dataset)
    edges, sample = neighbours.build_domain(parts["points"], k, parts["conformations"], names, keep=not black)
    files.write_domain(edges, sample, f"{dataset}/{files.PROJECTS}/{name}")
    return edges, sample


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    points = commands.add_parser("points")
    points.add_argument("dataset")
    points.add_argument("--components", type=int, default=500)
    points.add_argument("--sample", type=int, default=3000)
    domain = commands.add_parser("domain")
    lists = domain.add_mutually_exclusive_group()
    lists.add_argument("-w", dest="white", metavar="FILE")
    lists.add_argument("-b", dest="black", metavar="FILE")
    domain.add_argument("k", type=int)
    domain.add_argument("dataset")
    domain.add_argument("name")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    told = top.parse_args(arguments)
    if told.command == "domain" and told.k < 2:
        top.error("K must be at least 2")
    spark = spark or SparkSession.builder.getOrCreate()
    for path in (told.dataset, getattr(told, "white", None), getattr(told, "black", None)):
        if path and not structures.exists(spark, path):
            top.error(f"{path} does not exist")
    if told.command == "points":
        make_points(spark, told.dataset, told.components, told.sample)
    else:
        make_domain(spark, told.dataset, told.name, told.k, told.white, told.black)


if __name__ == "__main__":
    main()
