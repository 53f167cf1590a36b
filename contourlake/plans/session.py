"""The interface of a working session: what a client may ask for, over the tables of a dataset.

Every method is one plan and returns a DataFrame; nothing is collected but the place of a single structure. Structures are always named by their sampled id, and every column of the dataset is
mapped through the sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import full_match
from ..operators import paths, statistics, topology
from ..operators.common import cut, numbered, small
from ..sources import files, logs, structures


class Session:
    """A user's view of (dataset, project, function)."""

    def __init__(self, spark: SparkSession, root: str, user: str, dataset: str, project: str, function: str):
        self.spark, self.root, self.user = spark, root, user
        self.key = {"dataset": dataset, "project": project, "func": function}
        self.folder = f"{root}/{dataset}"
        self.parts = files.open_dataset(spark, self.folder)
        self.edges, self.sample = files.read_domain(spark, f"{self.folder}/{files.PROJECTS}/{project}")
        self.function = self.color_function(f"{self.folder}/{files.FUNCTIONS}/{function}")

    def _sampled(self, rows: DataFrame) -> DataFrame:
        """Rows of the sampled structures, named by s_id."""
        return rows.join(small(self.sample), "conf_id").drop("conf_id")

    def vertices(self) -> DataFrame:
        return self.function.select(F.lit("domain").alias("key"), F.col("s_id").alias("v"), "f")

    def tree(self, tau: float = 65.0) -> DataFrame:
        """The edges of the simplified critical tree; 65 is the threshold on opening a project."""
        return topology.tree_edges(self.vertices(), self.edges.select(F.lit("domain").alias("key"), "src", "dst"), tau)

    def edge_areas(self, tree: DataFrame) -> DataFrame:
        points = self._sampled(self.parts["points"]).select("s_id", F.col("v").alias("p"))
        inside = topology.members(tree).join(points, F.col("v") == F.col("s_id")).select("edge_id", F.col("p").alias("v"))
        return statistics.spread(inside, "edge_id")

    def areas(self, tau: float = 65.0) -> DataFrame:
        """The answer on opening a tree, one row: areas (edge_id, n1, n2, area of every edge of the critical tree), has_labels, functions (names of the dataset's function files)."""
        tree = cut(self.tree(tau), "tree")
        edges = tree.join(self.edge_areas(tree), "edge_id").select(F.struct("edge_id", "n1", "n2", "area").alias("e"))
        names = self.parts["functions"].agg(F.array_sort(F.collect_set("name")).alias("functions"))
        return edges.agg(F.array_sort(F.collect_list("e")).alias("areas")).withColumn("has_labels", F.lit(self.parts["labels"] is not None)).crossJoin(names)  # one row each

    def structure_lines(self, s_id: int) -> DataFrame:
        own = self.sample.filter(F.col("s_id") == s_id).first()
        return structures.one_structure(self.spark, self.folder, own["conf_id"] if own else -1).select("line_no", "line").orderBy("line_no")

    def labels(self, s_id: int, n_residues: int) -> DataFrame:
        """res_idx, label of one structure, of which only the own bytes are read; 'X' where there is none."""
        own = self.sample.filter(F.col("s_id") == s_id).first()
        return files.labels_of(files.labels_at(self.spark, self.parts["labels"], n_residues, own["conf_id"] if own else -1, s_id), s_id, n_residues)

    def color_function(self, path: str) -> DataFrame:
        """s_id, f of a function file."""
        return self._sampled(files.read_function(self.spark, path)).select("s_id", "f")

    def find(self, pattern: str) -> DataFrame:
        """path, s_id of the sampled structures whose whole path matches."""
        return self._sampled(self.parts["conformations"].filter(full_match(F.col("path"), pattern))).select("path", "s_id")

    def contacts(self, residues: list[int]) -> DataFrame:
        return self._sampled(statistics.contact_density(structures.backbone(structures.structure_lines(self.spark, self.folder)), residues)).select("s_id", "contacts")

    def shortest_path(self, start: int, end: int) -> DataFrame:
        points = self._sampled(self.parts["points"]).select(F.col("v").alias("p"), F.col("s_id").alias("v"))
        weighted = paths.weighted_edges(self.edges, points).withColumn("key", F.lit("domain"))
        return paths.shortest_path(weighted, [start], [end]).select("step", "v", "cost")

    def _log(self, kind: str, rows: DataFrame) -> None:
        logs.append_log(rows.withColumns({k: F.lit(v) for k, v in self.key.items()}), self.root, kind)

    def say(self, message: str) -> None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS")
        row = self.spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("seq"), logs.chat_line(now, F.lit(self.user), F.lit(message)).alias("line"))
        self._log("chat", row)

    def annotate(self, name: str, s_id: int, camera: list[float], ts: str) -> None:
        lines = self.structure_lines(s_id).agg(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"].alias("pdb"))
        self._log("annotations", lines.select(F.lit(name).alias("name"), F.lit(s_id).alias("s_id"), F.array(*map(F.lit, map(float, camera))).alias("camera"), "pdb", F.lit(ts).alias("ts")))

    def tell(self, name: str, ts: str, annotations: list[tuple[str, int, str]]) -> None:
        rows = self.spark.createDataFrame([(name, ts, annotations)], "name string, ts string, annotations array<struct<name:string,s_id:int,ts:string>>")
        self._log("storyboards", rows)

    def refresh(self, kind: str) -> DataFrame:
        """Everything logged for this project; the partition filter reads no other."""
        log = logs.read_log(self.spark, self.root, kind)
        for k, v in self.key.items():
            log = log.filter(F.col(k) == v)
        return log


def name_is_free(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """names(user) that no session(user) holds."""
    return names.join(sessions.select("user").distinct(), "user", "left_anti")


def missing_annotations(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The remote annotations that a client lacks, by (name, ts, s_id)."""
    return remote.join(local, ["name", "ts", "s_id"], "left_anti")


def resolve_storyboards(boards: DataFrame, annotations: DataFrame) -> DataFrame:
    """boards(name, annotations) -> board, place, and the annotation's own columns; a board that names an unknown annotation raises when run."""
    wanted = boards.select(F.col("name").alias("board"), F.posexplode("annotations").alias("place", "a")).select("board", "place", F.col("a.name").alias("name"), F.col("a.ts").alias("ts"), F.col("a.s_id").alias("s_id"))
    own = annotations.withColumn("_here", F.lit(True))
    found = wanted.join(own, ["name", "ts", "s_id"], "left")
    return found.filter(F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("unknown annotation: "), "name")).cast("boolean")).otherwise(True)).drop("_here")


def push_targets(rows: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each session of the project of each row."""
    return rows.join(sessions.select("user", *keys), keys)


def selected(selection: DataFrame) -> DataFrame:
    """selection(edge_id, group_id, at): the first selection of an edge holds."""
    return selection.groupBy("edge_id").agg(F.min_by("group_id", "at").alias("group_id"))


def selected_vertices(members: DataFrame, selection: DataFrame) -> DataFrame:
    """Distinct vertices of the selected edges."""
    return members.join(selection.select("edge_id").distinct(), "edge_id", "left_semi").select("v").distinct()


def selected_by_function(members: DataFrame, selection: DataFrame, function: DataFrame) -> DataFrame:
    """s_id, f, place: the vertices of the selected edges, the highest value first, ties to the smaller id."""
    own = selected_vertices(members, selection).withColumnRenamed("v", "s_id").join(function, "s_id").select("s_id", "f")
    return numbered(own, [F.col("f").desc(), F.col("s_id").asc()], "place")


def clear_selection(selection: DataFrame) -> DataFrame:
    """Every edge of a selection in group 0, which is none."""
    return selection.select("edge_id").distinct().withColumn("group_id", F.lit(0))


def disconnect(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    """The sessions that stay when users(user) leave; their names are free again."""
    return sessions.join(gone.select("user").distinct(), "user", "left_anti")


__all__ = ["Session", "clear_selection", "disconnect", "missing_annotations", "name_is_free", "push_targets", "resolve_storyboards", "selected", "selected_by_function", "selected_vertices"]
