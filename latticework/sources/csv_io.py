"""CSV readers and writers for nodes, edges, edge lists and multi-graph fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.errors import UsageError
from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import PropertyGraph
from latticework.operators.subgraph import numbered


#: Texts of numbers as Python reads them: single underscores between digits, white space around.
INT = r"^[+-]?\d+(_\d+)*$"
FLOAT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"


def coerced(text: Column) -> Column:
    """A cell as a tagged value: int, else float (so an int beyond 64 bits), else bool, else string."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    digits = F.replace(bare, F.lit("_"), F.lit(""))
    as_int, as_float = digits.try_cast("bigint"), digits.try_cast("double")
    return (
        F.when(bare.rlike(INT) & as_int.isNotNull(), V.tagged("int", as_int))
        .when(bare.rlike(FLOAT), V.tagged("float", as_float))
        .when(F.lower(text).isin("true", "false"), V.tagged("bool", F.lower(text)))
        .otherwise(V.tagged("str", text))
    )


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The rows of a CSV file with columns that tell their order in it, and the file's own columns."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    place = {"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()}
    return raw.withColumns(place), raw.columns


PLACE = ["__file", "__start", "__row"]


def _props(columns: list[str]) -> Column:
    """Cells that are not empty, as a property map."""
    if not columns:
        return F.create_map().cast(V.PROPS_TYPE)
    cells = F.array(*[F.struct(F.lit(c).alias("key"), F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != ""), coerced(F.col(f"`{c}`"))).alias("value")) for c in columns])
    return F.map_from_entries(F.filter(cells, lambda e: e["value"].isNotNull()))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """ext_id, id, labels, props of a file ``id,labels('|'),...``; ids from 1 in file order."""
    raw, columns = _read(spark, path)
    rest = [c for c in columns if c not in ("id", "labels")]
    labels = F.filter(F.transform(F.split(F.coalesce("labels", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.select(F.col("id").alias("ext_id"), labels.alias("labels"), _props(rest).alias("props"), *PLACE)
    return numbered(rows, PLACE, column="id").drop(*PLACE)


def read_edges(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Edges of a file ``from_id,label,to_id,...`` in file order, ends looked up among the external ids (of equal ones, the last); an unknown end is an error."""
    raw, columns = _read(spark, path)
    rest = [c for c in columns if c not in ("from_id", "label", "to_id")]
    ids = nodes.groupBy("ext_id").agg(F.max("id").alias("id"))
    end = lambda c, to: ids.select(F.col("ext_id").alias(c), F.col("id").alias(to))
    rows = raw.select("from_id", "label", "to_id", _props(rest).alias("props"), *PLACE)
    rows = cut(rows.join(end("from_id", "src"), "from_id", "left").join(end("to_id", "dst"), "to_id", "left"))
    lost = rows.filter("src is null or dst is null").select(F.when(F.col("src").isNull(), F.col("from_id")).otherwise(F.col("to_id")).alias("end")).first()
    if lost:
        raise UsageError(f"an edge refers to a node that does not exist: {lost['end']}")
    return numbered(rows, PLACE, column="id").select("id", "src", "dst", "label", "props")


def read_graph(spark: SparkSession, node_path: str, edge_path: str) -> PropertyGraph:
    nodes = read_nodes(spark, node_path)
    return PropertyGraph(nodes.select("id", "labels", "props"), read_edges(spark, edge_path, nodes))


def read_named_graph(spark: SparkSession, node_path: str, edge_path: str, name: str) -> PropertyGraph:
    """One graph of files ``graph,order,ref,labels(;),properties_json`` and ``graph,order,from_ref,label,to_ref,properties_json``."""
    import json

    def rows(path: str):
        got = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).filter(F.col("graph") == name).collect()
        return sorted(got, key=lambda r: int(r["order"]))

    parse = lambda text: json.loads(text) if text else {}
    nodes, refs = [], {}
    for i, r in enumerate(rows(node_path), 1):
        refs[r["ref"]] = i
        nodes.append(([x for x in (r["labels"] or "").split(";") if x], parse(r["properties_json"])))
    edges = [(refs[r["from_ref"]], r["label"], refs[r["to_ref"]], parse(r["properties_json"])) for r in rows(edge_path)]
    return PropertyGraph.of(spark, nodes, edges)


def read_indexed_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, label of rows (from_index, to_index, label) whose ends are places in ``nodes`` (columns pos, id)."""
    at = lambda c, to: nodes.select(F.col("pos").alias(c), F.col("id").alias(to))
    return rows.join(at("from_index", "src"), "from_index").join(at("to_index", "dst"), "to_index").select("src", "dst", "label")


def _cells(keys: list[str]) -> list[Column]:
    return [F.coalesce(V.prop(k)["v"], F.lit("")).alias(k) for k in keys]


def property_keys(df: DataFrame) -> list[str]:
    return sorted(r["k"] for r in df.select(F.explode(F.map_keys("props")).alias("k")).distinct().collect())


def write_nodes(nodes: DataFrame, path: str) -> None:
    """``id,labels('|'),...`` with the sorted union of property keys."""
    nodes.select("id", F.array_join("labels", "|").alias("labels"), *_cells(property_keys(nodes))).orderBy("id").write.csv(path, header=True)


def write_edges(edges: DataFrame, path: str) -> None:
    """``id,label,from_node,to_node,...`` with the sorted union of property keys."""
    edges.select("id", "label", F.col("src").alias("from_node"), F.col("dst").alias("to_node"), *_cells(property_keys(edges))).orderBy("id").write.csv(path, header=True)
