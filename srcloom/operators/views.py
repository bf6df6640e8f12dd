"""View-side projections of a graph slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the grid and its steps; opacity of what is not selected; colours of edges.
COLUMNS, STEP_X, STEP_Y = 5, 250, 150
FADED_NODE, FADED_EDGE = 0.4, 0.2
IMPORT_COLOUR, OTHER_COLOUR = "#3b82f6", "#10b981"
STEPS = ("queued", "cloning", "scanning", "resolving", "storing", "done")


def present_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def grid(nodes: DataFrame) -> DataFrame:
    """(id, x, y) of a slice (at most some thousand nodes) in a grid, in order of id."""
    i = F.row_number().over(Window.orderBy("id")) - 1
    return nodes.select("id", i.alias("i")).select("id", (F.col("i") % COLUMNS * STEP_X).alias("x"), (F.floor(F.col("i") / COLUMNS) * STEP_Y).alias("y"))


def highlight(nodes: DataFrame, edges: DataFrame, selected: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with opacity, edges with opacity and colour) when one node is selected."""
    touching = (F.col("from_id") == selected) | (F.col("to_id") == selected)
    near = edges.filter(touching).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("near", F.lit(True))
    n = nodes.join(near, "id", "left").withColumn("opacity", F.when(F.col("near") | (F.col("id") == selected), 1.0).otherwise(FADED_NODE)).drop("near")
    colour = F.when(F.col("kind") == "IMPORTS", IMPORT_COLOUR).otherwise(OTHER_COLOUR)
    return n, edges.withColumns({"opacity": F.when(touching, 1.0).otherwise(FADED_EDGE), "colour": colour})


def details(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(direction, kind, other, label) of a node's edges; the label is the other node's name, else its id."""
    names = nodes.select(F.col("id").alias("other"), "name")
    out = edges.filter(F.col("from_id") == node_id).select(F.lit("outgoing").alias("direction"), "kind", F.col("to_id").alias("other"))
    into = edges.filter(F.col("to_id") == node_id).select(F.lit("incoming").alias("direction"), "kind", F.col("from_id").alias("other"))
    return out.union(into).join(names, "other", "left").select("direction", "kind", "other", F.coalesce("name", "other").alias("label"))


def ui_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary of the user interface: (id, type, label, data) and (id, source, target, type)."""
    n = nodes.select("id", F.lower("kind").alias("type"), F.col("name").alias("label"), F.to_json(F.struct("path", "language", "start_line", "end_line")).alias("data"))
    return n, edges.select("id", F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.lower("kind").alias("type"))


def step_state(status: Column, stage: Column, step: str) -> Column:
    """How a job stands at one of the steps: done, active, failed or waiting."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, STEPS)), stage), F.lit(0))
    own = STEPS.index(step) + 1
    return F.when((status == "completed") | (at > own), "done").when(status.isin("failed", "cancelled") & (at == own), "failed").when((at == own) & (status == "running"), "active").otherwise("waiting")


def envelope(data: Column) -> Column:
    """The JSON of a successful answer."""
    return F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")))
