"""Deterministic JSON export, import, manifest and signature."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from latticework.errors import CorruptedGraphError, UsageError
from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import Edge, Node, PropertyGraph
from latticework.operators.subgraph import remapped
from latticework.sources.folder import Folder

#: Fixed values of the exchange format.
FORMAT_VERSION, EXPORT_VERSION, MANIFEST_VERSION = "1.0", 1, 1
ALGORITHM = "HMAC-SHA256"


@F.pandas_udf(StringType())
def _nested_json(t: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(V.decode(a, b), ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")) if a in ("list", "map") else None for a, b in zip(t, v, strict=True)], dtype=object)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', "")


def json_float(text: Column) -> Column:
    """One form for each float, whoever wrote its text; NaN and infinity are refused."""
    number = text.cast("double")
    refused = F.raise_error(F.lit("NaN and infinity cannot be exported")).cast("string")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), refused).otherwise(number.cast("string"))


def json_value(value: Column, nested: bool) -> Column:
    """JSON text of a tagged value; ``nested`` says whether lists and maps can occur, which need Python."""
    t, v = value["t"], value["v"]
    plain = F.when(t == "null", "null").when(t == "str", quoted(v)).when(t == "float", json_float(v))
    return (plain.when(t.isin("list", "map"), _nested_json(t, v)) if nested else plain).otherwise(v)


def json_props(df: DataFrame) -> DataFrame:
    """``df`` with its property maps as JSON texts in column __props."""
    if df.filter(F.exists(F.map_values("props"), lambda x: x["t"].isin("list", "map"))).limit(1).isEmpty():
        parts = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(quoted(e["key"]), F.lit(":"), json_value(e["value"], False)))
        return df.withColumn("__props", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
    rows = df.select("id", F.explode("props").alias("key", "value")).withColumn("text", F.concat(quoted(F.col("key")), F.lit(":"), json_value(F.col("value"), True)))
    texts = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("parts"))
    joined = df.join(texts, "id", "left").withColumn("parts", F.coalesce(F.transform("parts", lambda e: e["text"]), F.array().cast("array<string>")))
    return joined.withColumn("__props", F.concat(F.lit("{"), F.array_join("parts", ","), F.lit("}")))


def node_lines(nodes: DataFrame) -> DataFrame:
    """id, line: one JSON object for each node, keys and labels sorted; made on the executors."""
    return json_props(nodes).select("id", F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"labels":'), F.to_json(F.array_sort("labels")), F.lit(',"properties":'), "__props", F.lit("}")).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    label = quoted(F.col("label"))
    return json_props(edges).select(
        "id",
        F.concat(F.lit('{"from_node":'), F.col("src").cast("string"), F.lit(',"id":'), F.col("id").cast("string"), F.lit(',"label":'), label, F.lit(',"properties":'), "__props", F.lit(',"to_node":'), F.col("dst").cast("string"), F.lit("}")).alias("line"),
    )


def document(graph: PropertyGraph, kind: str) -> dict[str, Any]:
    """The whole graph as one document, for graphs that fit on the driver."""
    nodes = [{"id": n.id, "labels": sorted(n.labels), "properties": n.properties} for n in map(Node.of, graph.all_nodes().collect())]
    edges = [{"id": e.id, "from_node": e.from_node, "to_node": e.to_node, "label": e.label, "properties": e.properties} for e in map(Edge.of, graph.all_edges().collect())]
    for item in (*nodes, *edges):
        if not V.finite(item["properties"]):
            raise UsageError("NaN and infinity cannot be exported")
    return {"edge_count": len(edges), "edges": edges, kind: EXPORT_VERSION if kind == "export_version" else MANIFEST_VERSION, "format_version": FORMAT_VERSION, "node_count": len(nodes), "nodes": nodes}


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True) + "\n"


def listed(rows: DataFrame, of) -> Iterator[str]:
    """The members of a JSON list, in id order; the driver holds one partition of rows at a time."""
    first = True
    for r in rows.orderBy("id").toLocalIterator():
        item = of(r)
        if not V.finite(item["properties"]):
            raise UsageError("NaN and infinity cannot be exported")
        text = json.dumps(item, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True)
        yield ("\n    " if first else ",\n    ") + text.replace("\n", "\n    ")
        first = False
    yield "]" if first else "\n  ]"


def document_parts(graph: PropertyGraph, kind: str) -> Iterator[str]:
    """The text of document(), piece by piece, for graphs of any size."""

    def node(r) -> dict[str, Any]:
        n = Node.of(r)
        return {"id": n.id, "labels": sorted(n.labels), "properties": n.properties}

    def edge(r) -> dict[str, Any]:
        e = Edge.of(r)
        return {"id": e.id, "from_node": e.from_node, "to_node": e.to_node, "label": e.label, "properties": e.properties}

    version = EXPORT_VERSION if kind == "export_version" else MANIFEST_VERSION
    scalars = {"edge_count": graph.edge_count(), kind: version, "format_version": FORMAT_VERSION, "node_count": graph.node_count()}
    lists = {"edges": (graph.edges, edge), "nodes": (graph.nodes, node)}
    yield "{"
    for i, name in enumerate(sorted(scalars | lists)):
        yield ("," if i else "") + f'\n  "{name}": '
        if name in lists:
            yield "["
            yield from listed(*lists[name])
        else:
            yield json.dumps(scalars[name])
    yield "\n}\n"


def export_json(graph: PropertyGraph) -> str:
    return "".join(document_parts(graph, "export_version"))


def manifest(graph: PropertyGraph) -> str:
    return "".join(document_parts(graph, "manifest_version"))


def plain_json(graph: PropertyGraph) -> str:
    """Nodes and edges alone, without versions and counts; labels as they stand."""
    nodes = [{"id": n.id, "labels": list(n.labels), "properties": n.properties} for n in map(Node.of, graph.all_nodes().collect())]
    edges = [{"id": e.id, "from_node": e.from_node, "to_node": e.to_node, "label": e.label, "properties": e.properties} for e in map(Edge.of, graph.all_edges().collect())]
    return json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False, indent=2)


def sign(graph: PropertyGraph, key: bytes) -> dict[str, str]:
    """Digest and signature of the manifest, taken while it passes."""
    digest, signed = hashlib.sha256(), hmac.new(key, digestmod=hashlib.sha256)
    for part in document_parts(graph, "manifest_version"):
        digest.update(part.encode())
        signed.update(part.encode())
    return {"algorithm": ALGORITHM, "format_version": FORMAT_VERSION, "sha256": digest.hexdigest(), "signature": signed.hexdigest()}


def verify(graph: PropertyGraph, key: bytes, signature: dict[str, str]) -> dict[str, bool]:
    now = sign(graph, key)
    compatible = all(signature.get(k) == now[k] for k in ("algorithm", "format_version"))
    digest = hmac.compare_digest(str(signature.get("sha256")), now["sha256"])
    signed = hmac.compare_digest(str(signature.get("signature")), now["signature"])
    return {"compatible": compatible, "digest": digest, "signature": signed, "valid": compatible and digest and signed}


def checked(data: Any) -> tuple[list[dict], list[dict]]:
    if not isinstance(data, dict) or data.get("export_version") != EXPORT_VERSION:
        raise UsageError("not an export of a known version")
    nodes, edges = data.get("nodes"), data.get("edges")
    if not isinstance(nodes, list) or not isinstance(edges, list):
        raise UsageError("nodes and edges must be lists")
    for n in nodes:
        if not (isinstance(n, dict) and isinstance(n.get("id"), int) and isinstance(n.get("labels"), list) and all(isinstance(x, str) for x in n["labels"]) and isinstance(n.get("properties"), dict)):
            raise UsageError("a node is not well formed")
    for e in edges:
        if not (isinstance(e, dict) and all(isinstance(e.get(k), int) for k in ("id", "from_node", "to_node")) and isinstance(e.get("label"), str) and isinstance(e.get("properties"), dict)):
            raise UsageError("an edge is not well formed")
    return nodes, edges


def import_json(spark: SparkSession, text: str) -> PropertyGraph:
    """Checked and numbered anew from 1 in id order; an edge without both ends is refused."""
    try:
        nodes, edges = checked(json.loads(text))
    except ValueError as e:
        raise UsageError(f"not JSON: {e}") from e
    ids = {n["id"] for n in nodes}
    for e in edges:
        if e["from_node"] not in ids or e["to_node"] not in ids:
            raise UsageError(f"edge {e['id']} refers to a node that does not exist")
    ns = spark.createDataFrame([(n["id"], n["labels"], V.encode_props(n["properties"])) for n in nodes], V.NODE_SCHEMA)
    es = spark.createDataFrame([(e["id"], e["from_node"], e["to_node"], e["label"], V.encode_props(e["properties"])) for e in edges], V.EDGE_SCHEMA)
    return PropertyGraph(*remapped(ns, es), next_node=len(nodes) + 1, next_edge=len(edges) + 1)


DOCUMENT = "export_version string, nodes array<struct<id: long, labels: array<string>, properties: string>>, edges array<struct<id: long, from_node: long, to_node: long, label: string, properties: string>>"


def import_document(spark: SparkSession, path: str) -> PropertyGraph:
    """import_json() of a file, read and checked on the executors; the file is one record, and so of at most 2 GB."""
    doc = cut(spark.read.schema(f"{DOCUMENT}, __broken string").json(path, multiLine=True, columnNameOfCorruptRecord="__broken"))
    facts = doc.agg(F.count(F.lit(1)).alias("n"), F.max("export_version").alias("version"), F.max(F.col("nodes").isNull() | F.col("edges").isNull()).alias("lost"), F.max(F.col("__broken").isNotNull()).alias("broken")).first()
    if facts["broken"]:
        raise UsageError(f"not JSON of an export: {path}")
    if facts["n"] != 1 or facts["version"] != str(EXPORT_VERSION):
        raise UsageError("not an export of a known version")
    if facts["lost"]:
        raise UsageError("nodes and edges must be lists")
    nodes, edges = (doc.select(F.explode(c).alias("x")).select("x.*") for c in ("nodes", "edges"))
    whole = lambda df: F.forall(F.array(*[F.col(c).isNotNull() for c in df.columns]), lambda x: x) & F.col("properties").startswith("{")
    broken = nodes.filter(~F.coalesce(whole(nodes) & F.forall("labels", lambda x: x.isNotNull()), F.lit(False))).select("id").union(edges.filter(~F.coalesce(whole(edges), F.lit(False))).select("id"))
    if not broken.isEmpty():
        raise UsageError("a node or an edge is not well formed")
    props = _tagged_props("properties").alias("props")
    try:
        return PropertyGraph(*remapped(nodes.select("id", "labels", props), edges.select("id", F.col("from_node").alias("src"), F.col("to_node").alias("dst"), "label", props)))
    except CorruptedGraphError as e:
        raise UsageError(str(e)) from e


def bulk_json(spark: SparkSession, text: str) -> PropertyGraph:
    """Nodes and edges in file order without checks; edges name their ends by the file's ids."""
    data = json.loads(text)
    new = {n["id"]: i for i, n in enumerate(data["nodes"], 1)}
    nodes = [(n.get("labels", []), n.get("properties", {})) for n in data["nodes"]]
    edges = [(new[e["from_node"]], e["label"], new[e["to_node"]], e.get("properties", {})) for e in data.get("edges", [])]
    return PropertyGraph.of(spark, nodes, edges)


def write_lines(graph: PropertyGraph, path: str) -> None:
    """Node and edge lines as text files in two folders, sorted by id, for graphs of any size."""
    node_lines(graph.nodes).repartitionByRange("id").sortWithinPartitions("id").select("line").write.text(f"{path}/nodes")
    edge_lines(graph.edges).repartitionByRange("id").sortWithinPartitions("id").select("line").write.text(f"{path}/edges")


def read_lines(spark: SparkSession, path: str) -> PropertyGraph:
    """What write_lines() wrote, ids kept; a line's fields are parsed by schema, its properties, which have none, in Arrow batches."""
    props = _tagged_props("properties").alias("props")
    nodes = spark.read.schema("id long, labels array<string>, properties string").json(f"{path}/nodes").select("id", "labels", props)
    edges = spark.read.schema("id long, from_node long, to_node long, label string, properties string").json(f"{path}/edges")
    return PropertyGraph(nodes, edges.select("id", F.col("from_node").alias("src"), F.col("to_node").alias("dst"), "label", props))


@F.pandas_udf(V.PROPS)
def _tagged_props(text: pd.Series) -> pd.Series:
    """Property maps of JSON objects."""
    return pd.Series([{k: {"t": t, "v": v} for k, (t, v) in V.encode_props(json.loads(x)).items()} for x in text], dtype=object)


def save(spark: SparkSession, parts: Iterable[str], path: str, force: bool = False) -> None:
    """Write the parts to a file; an old one gives way only when all is written."""
    folder, _, name = Folder(spark, path).path.rpartition("/")
    place = Folder(spark, folder)
    if not force and place.exists(name):
        raise UsageError(f"{path} exists; use --force to replace it")
    temporary = f"{name}.{uuid.uuid4().hex}"
    try:
        stream = place.fs.create(place.at(temporary), True)
        held: list[str] = []
        for part in parts:
            held.append(part)
            if len(held) >= 4096:
                stream.write(bytearray("".join(held).encode()))
                held = []
        stream.write(bytearray("".join(held).encode()))
        stream.close()
        place.replace(temporary, name)
    finally:
        place.delete(temporary)
