"""Manifests as rows of nodes, edits of them, and manifests written from the rows.

``parse_nodes`` gives every element with its parent and place, so nothing of a manifest is
lost on the way: attributes, texts, and the prefixes that it declares. ``restructured``
joins what :func:`packloom.operators.manifest.restructure` makes of the items to them:
titles, places, new headers; it touches no node that stays as it is. ``write_manifests``
rebuilds one manifest at a time from rows that Spark has sorted by package.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packloom.operators import manifest
from packloom.runtime import materialise, prepare

# Prefixes of the namespaces of course packages.
NAMESPACES = {
    "": "http://www.imsglobal.org/xsd/imscp_v1p1",
    "imsmd": "http://www.imsglobal.org/xsd/imsmd_rootv1p2p1",
    "d2l_2p0": "http://desire2learn.com/xsd/d2lcp_v2p0",
    "lom": "http://ltsc.ieee.org/xsd/LOM",
    "dc": "http://purl.org/dc/elements/1.1/",
}
_MAP = pa.map_(pa.string(), pa.string())
NODE = "node int, parent int, pos int, tag string, attributes map<string,string>, text string, tail string, prefixes map<string,string>, item int"
#: Places behind all that a module has.
BEHIND = 1_000_000.0


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _rows(xml: str) -> list[tuple]:
    """Nodes of a manifest in document order. ``item`` numbers the items of the
    organization as :func:`packloom.operators.manifest.parse_manifests` does."""
    prefixes: list[tuple[str, str]] = []
    root = None
    for event, x in ET.iterparse(io.BytesIO(xml.encode()), events=("start-ns", "start")):
        if event == "start-ns":
            prefixes.append(x)
        elif root is None:
            root = x
    out: list[tuple] = []
    items = 0
    # A node, its parent's number, its place, and whether items below it are the outline's.
    stack = [(root, None, 0, True)]
    while stack:
        e, parent, pos, counts = stack.pop()
        node = len(out)
        name = _local(e.tag) if isinstance(e.tag, str) else ""
        number = None
        if counts and name == "item":
            items += 1
            number = items
        counts = counts and (parent is None or name in ("manifest", "organizations", "organization", "item"))
        out.append((node, parent, pos, e.tag, list(e.attrib.items()), e.text, e.tail, list(dict(prefixes).items()) if parent is None else None, number))
        stack += [(c, node, i, counts) for i, c in reversed(list(enumerate(e)))]
    return out


def parse_nodes(df: DataFrame, key: str = "package", xml: str = "content") -> DataFrame:
    """DataFrame[key, node, parent, pos, tag, attributes, text, tail, prefixes, item] of
    manifests. Comments go; a broken or empty manifest gives no nodes."""
    kind = dict(df.dtypes)[key]
    names = [key, *(c.split()[0] for c in NODE.split(", "))]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), _MAP, pa.string(), pa.string(), _MAP, pa.int32()]

    def run(batches):
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = _rows(x) if x else []
                except ET.ParseError:
                    rows = []
                if rows:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), b.schema.field(0).type), *columns], names=names)

    prepare(df.sparkSession)
    return df.select(key, xml).mapInArrow(run, f"`{key}` {kind}, {NODE}")


def restructured(nodes: DataFrame, items: DataFrame, key: str = "package", beside_template: bool = False) -> DataFrame:
    """Nodes with the titles, the order and the headers of the template.

    ``items`` are those of ``parse_manifests`` over the same manifests. Modules "Module n:
    x" whose children's references or titles change get their items in the new order behind
    all else that they hold; headers of other modules stand right before the item that they
    lead. Titles of all levels lose their bars. Nodes that a column ``header`` (a title) and
    ``seed`` name are headers that ``write_manifests`` makes.
    """
    # Each is read several times below: parsed once, and written.
    nodes, items = materialise(nodes, "nodes"), materialise(items, "items")
    shape = materialise(manifest.restructure(items, key, beside_template), "structure")
    at = items.join(nodes.where("item IS NOT NULL").select(key, F.col("item").alias("ordinal"), "node", F.col("pos").alias("old")), [key, "ordinal"])
    tops = at.where("depth = 0").select(key, F.col("item_id").alias("parent_id"), F.col("node").alias("module_node"))
    kids = at.where("depth = 1").select(key, "parent_id", "item_id", F.coalesce("identifierref", F.lit("")).alias("ref"), F.col("title").alias("was"), "node", "old", "ordinal")
    made = shape.join(tops, [key, "parent_id"]).join(kids.select(key, "parent_id", "item_id", "ref", "node", "old"), [key, "parent_id", "item_id"], "left")
    made = made.withColumn("number", manifest.module_number(F.col("module")))
    # What a module's children are before and after, as lists of its own manifest.
    pair = lambda at_, ref, title: F.transform(F.sort_array(F.collect_list(F.struct(at_, F.col(ref).alias("r"), F.col(title).alias("t")))), lambda x: F.struct(x["r"], x["t"]))
    before = kids.groupBy(key, "parent_id").agg(pair("ordinal", "ref", "was").alias("before"))
    after = made.withColumn("ref", F.coalesce("ref", F.lit(""))).groupBy(key, "parent_id").agg(pair("position", "ref", "title").alias("after"))
    moved = before.join(after, [key, "parent_id"]).select(key, "parent_id", (F.col("before") != F.col("after")).alias("moved"))
    w = Window.partitionBy(key, "parent_id").orderBy("position")
    made = made.join(moved, [key, "parent_id"]).withColumn("next", F.lead("old").over(w))
    rebuilt = F.col("number").isNotNull() & F.col("moved")
    placed = made.where(rebuilt | F.col("number").isNull()).withColumn("place", F.when(rebuilt, F.lit(BEHIND) + F.col("position")).when(F.col("is_header"), F.col("next") - 0.5).otherwise(F.col("old").cast("double")))
    # Old headers of rebuilt modules have no row left; their items' nodes go.
    modules = placed.where(rebuilt).select(key, "parent_id").distinct()
    gone = kids.join(modules, [key, "parent_id"]).join(placed.where("node IS NOT NULL").select(key, "node"), [key, "node"], "left_anti").select(key, "node")
    plain = manifest.normal_delimiters
    titles = (
        at.where("depth = 0").select(key, "node", "title", plain(manifest.top_title(F.col("title"), beside_template)).alias("new"))
        .unionByName(at.where("depth > 1").select(key, "node", "title", plain(F.col("title")).alias("new")))
        .unionByName(made.where("node IS NOT NULL").join(kids.select(key, "node", "was"), [key, "node"]).select(key, "node", F.col("was").alias("title"), F.when(rebuilt | F.col("number").isNull(), F.col("title")).otherwise(F.col("was")).alias("new")))
        .where("title <> new")
    )
    holder = nodes.where(F.element_at(F.split("tag", "}"), -1) == "title").groupBy(key, "parent").agg(F.min_by("node", "pos").alias("node"))
    texts = titles.select(key, F.col("node").alias("parent"), "new").join(holder, [key, "parent"]).select(key, "node", "new")
    kept = nodes.join(gone, [key, "node"], "left_anti").join(placed.where("node IS NOT NULL").select(key, "node", "place"), [key, "node"], "left").join(texts, [key, "node"], "left")
    none = F.lit(None).cast("string")
    rows = kept.select(key, "node", "parent", F.coalesce("place", F.col("pos").cast("double")).alias("pos"), "tag", "attributes", F.coalesce("new", "text").alias("text"), "tail", "prefixes", none.alias("header"), none.alias("seed"))
    seed = F.concat(F.lit("module_"), F.coalesce("number", F.lit(0)).cast("string"), F.lit("_"), "title", F.lit("_header"))
    heads = placed.where("is_header").select(key, F.col("module_node").alias("parent"), F.col("place").alias("pos"), F.col("title").alias("header"), seed.alias("seed"))
    return rows.unionByName(heads, allowMissingColumns=True)


def _built(rows: list[dict]) -> str:
    """The manifest of its nodes. Nodes without a parent among them are left out."""
    below: dict[int | None, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    for of in below.values():
        of.sort(key=lambda r: (r["pos"], r["node"] is not None))
    names = {v for r in rows for k, v in r["attributes"] or () if k == "identifier"}
    top = next(r for r in below[None] if r["node"] is not None)
    made: list[ET.Element] = []
    stack: list[tuple[dict, ET.Element | None]] = [(top, None)]
    while stack:
        r, parent = stack.pop()
        if r["node"] is None:
            space = parent.tag[: parent.tag.index("}") + 1] if parent.tag[:1] == "{" else ""
            base = name = "auto_" + (re.sub(r"[^a-z0-9]+", "_", r["seed"].lower()).strip("_") or "auto_item")
            n = 1
            while name in names:
                n += 1
                name = f"{base}_{n}"
            names.add(name)
            e = ET.Element(f"{space}item", {"identifier": name})
            ET.SubElement(e, f"{space}title").text = r["header"]
        else:
            e = ET.Element(r["tag"], dict(r["attributes"] or ()))
            e.text, e.tail = r["text"], r["tail"]
            stack += [(c, e) for c in reversed(below.get(r["node"], []))]
        made.append(e)
        if parent is not None:
            parent.append(e)
    for prefix, uri in {**dict(top["prefixes"] or ()), **NAMESPACES}.items():
        if not re.fullmatch(r"ns\d+", prefix):  # kept for those without a prefix
            ET.register_namespace(prefix, uri)
    return ET.tostring(made[0], encoding="utf-8", xml_declaration=True).decode()


def write_manifests(nodes: DataFrame, key: str = "package") -> DataFrame:
    """DataFrame[key, content]: manifests of ``parse_nodes`` or ``restructured``. Rows are
    dealt and sorted by package; a task holds the nodes of one manifest."""
    kind = dict(nodes.dtypes)[key]
    named = nodes.columns
    for c in ("header", "seed"):
        nodes = nodes if c in named else nodes.withColumn(c, F.lit(None).cast("string"))
    columns = ["node", "parent", "pos", "tag", "attributes", "text", "tail", "prefixes", "header", "seed"]
    dealt = nodes.select(key, *columns[:2], F.col("pos").cast("double").alias("pos"), *columns[3:]).repartition(key).sortWithinPartitions(key)

    def run(batches):
        now, held = None, []

        def batch(b):
            return pa.RecordBatch.from_arrays([pa.array([now[0]], b.schema.field(0).type), pa.array([_built(held)], pa.string())], names=[key, "content"])

        b = None
        for b in batches:
            for k, *values in zip(*(c.to_pylist() for c in b.columns)):
                if now != (k,):
                    if held:
                        yield batch(b)
                    now, held = (k,), []
                held.append(dict(zip(columns, values)))
        if held:
            yield batch(b)

    prepare(nodes.sparkSession)
    return dealt.mapInArrow(run, f"`{key}` {kind}, content string")
