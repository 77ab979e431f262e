"""Merkle manifest: digests of all rows as trees per language, proofs and tampered versions.

Leaves of a language stand in the order of doc_id. While more than one node remains, every
two consecutive ones become the digest of both; a last one without a partner is hashed by
itself. The subroots of the languages form one more such tree, whose top is the root.

Position: rows are range-partitioned by (language, doc_id), so that a hot language is many
tasks' work, and a row's place is its place in its partition plus the rows before it.

Persistent tree: the tree is cut into aligned blocks of ``2 ** BITS`` nodes. Upwards, a task
turns a block into its top node, level after level of blocks, until one node is left.
Downwards, a block hands each node the siblings on its way to the root. A tampered leaf is
a version of the tree: it copies the ancestors within its block and goes on with the
siblings above it, so each version costs as many new nodes as the tree has levels and shares
all others. Versions are worked on where their leaf is, never in the block of the root.
No task holds more than one block with its nodes' paths; texts are hashed where they are
read and never shuffled.

A null is the field ``-``. Null doc_ids come first, equal ones in the order of their leaves;
rows that repeat are leaves of their own. Very long texts are hashed whole. A null doc_id is
not tampered. An empty table gives an empty result. Other columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import reliable_checkpoint

BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
#: A step of a path: the sibling's digest after the side on which it stands, or nothing for a
#: node without a partner.
LEFT, RIGHT, ALONE = "L", "R", ""
PATHS = "g string, pos long, path array<string>, subroot string, root string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    joined = F.concat(*[field(values[name]) for name in FIELDS])
    return F.sha2(F.encode(joined, "UTF-8"), 256)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, the group ``g`` of its language, its leaf, and the leaf once it is tampered with."""
    values = {name: F.col(name) for name in FIELDS}
    more = {**values, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPER == 0
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
        .alias("g"), leaf_of(values).alias("node"),
        F.when(chosen, leaf_of(more)).alias("changed"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place within ``g`` by ``order``, and ``total``, the rows of ``g``."""
    laid = reliable_checkpoint(
        rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order))
    number = F.monotonically_increasing_id()
    known = laid.withColumns({"part": F.shiftright(number, 33), "ordinal": number})
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = known.groupBy("g", "part").agg(
        F.min("ordinal").alias("first"), F.count("*").alias("n")).select(
            "g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
            .alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    return known.join(spans, ["g", "part"]).withColumn(
        "pos", F.col("ordinal") + F.col("shift")).drop("part", "ordinal", "shift")


def _levels(nodes: list[str], total: int) -> list[list[str]]:
    """The block's nodes level by level; as many levels as its tree of ``total`` needs."""
    levels = [nodes]
    for _ in range(min(BITS, (total - 1).bit_length())):
        low = levels[-1]
        levels.append([digest_of(*low[k:k + 2]) for k in range(0, len(low), 2)])
    return levels


def _path(levels: list[list[str]], place: int) -> list[str]:
    """The siblings of a node of the lowest level, up to the block's top."""
    path = []
    for level in levels[:-1]:
        other = place ^ 1
        path.append(ALONE if other >= len(level) else
                    (LEFT if other < place else RIGHT) + level[other])
        place >>= 1
    return path


def copied(node: str, path: list[str]) -> list[str]:
    """The nodes of a version: the new leaf and its new ancestors; the last one is its root."""
    nodes = [node]
    for step in path:
        other = step[1:]
        nodes.append(digest_of(other, nodes[-1]) if step.startswith(LEFT)
                     else digest_of(nodes[-1], other))
    return nodes


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("pos")


def _top(block: pa.Table) -> pa.Table:
    block = _ordered(block)
    total = block["total"][0].as_py()
    return pa.table({
        "g": block["g"].slice(0, 1), "pos": pa.array([block["pos"][0].as_py() >> BITS]),
        "total": pa.array([-(-total >> BITS)]),
        "node": pa.array([_levels(block["node"].to_pylist(), total)[-1][0]])})


def _blocks(nodes: DataFrame):
    return nodes.groupBy("g", F.shiftright("pos", BITS).alias("block"))


def raised(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (g, pos, total, node) of every level of blocks; the last holds one per g."""
    floors = [leaves.select("g", "pos", "total", "node")]
    widest = floors[0].agg(F.max("total")).first()[0] or 0
    while widest > 1:
        floors.append(reliable_checkpoint(_blocks(floors[-1]).applyInArrow(
            _top, "g string, pos long, total long, node string")))
        widest = -(-widest >> BITS)
    return floors


def _down(nodes: DataFrame, paths: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every block with the path of its top."""
    tops = paths.select(F.col("g").alias("top_g"), F.col("pos").alias("block"), "path",
                        "subroot", "root")
    return _blocks(nodes).cogroup(tops.groupBy("top_g", "block")).applyInArrow(work, schema)


def _extended(block: pa.Table, above: pa.Table) -> pa.Table:
    block, top = _ordered(block), above.to_pylist()[0]
    levels = _levels(block["node"].to_pylist(), block["total"][0].as_py())
    rest = top["path"]
    count = block.num_rows
    return pa.table({
        "g": block["g"], "pos": block["pos"],
        "path": pa.array([_path(levels, k) + rest for k in range(count)], pa.list_(pa.string())),
        "subroot": pa.array([top["subroot"]] * count, pa.string()),
        "root": pa.array([top["root"]] * count, pa.string())})


def lowered(floors: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths of the nodes on the second floor, from those of the tops (g, pos 0)."""
    paths = top
    for nodes in floors[-2:0:-1]:
        paths = reliable_checkpoint(_down(nodes, paths, _extended, PATHS))
    return paths


def _language_paths(subroots: DataFrame) -> DataFrame:
    """The path from every language's subroot to the root of all."""
    own = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "node"), ["lang"])
    own = reliable_checkpoint(own)
    floors = raised(own)
    top = floors[-1].select(
        "g", "pos", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"),
        F.col("node").alias("root"))
    if len(floors) == 1:  # a single language, or none
        found = own.drop("node").join(top, ["g", "pos"])
    else:
        found = own.drop("node").join(
            _down(floors[0], lowered(floors, top), _extended, PATHS), ["g", "pos"])
    return found.select(F.col("lang").alias("g"), "path", "root")


def _verified(block: pa.Table, above: pa.Table) -> pa.Table:
    """The leaves of a block with their paths and, for tampered ones, their versions."""
    found = _extended(block, above)
    block = _ordered(block)
    paths = found["path"].to_pylist()
    versions = [copied(changed or leaf, path) for leaf, changed, path in zip(
        block["node"].to_pylist(), block["changed"].to_pylist(), paths)]
    return pa.table({
        "doc_id": block["doc_id"], "g": block["g"], "pos": block["pos"], "leaf": block["node"],
        "changed": block["changed"], "path": found["path"], "subroot": found["subroot"],
        "root": found["root"], "copied": pa.array(versions, pa.list_(pa.string()))})


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document of the tree and its versions.

    doc_id, g, pos, leaf, subroot and root; ``path``, the siblings from leaf to root with
    their sides; ``changed``, the tampered leaf or null; ``copied``, the nodes of the version
    that has this leaf, or the leaf and its ancestors as they are if nothing was changed.
    """
    leaves = placed(hashed(docs), ["doc_id", "node"])
    floors = raised(leaves)
    languages = _language_paths(floors[-1] if len(floors) > 1 else floors[0])
    top = floors[-1].join(languages, "g").select(
        "g", "pos", "path", F.col("node").alias("subroot"), "root")
    paths = lowered(floors, reliable_checkpoint(top))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _down(leaves, paths, _verified, f"""doc_id {kind}, g string, pos long, leaf string,
        changed string, path array<string>, subroot string, root string, copied array<string>""")


def version_nodes(rows: DataFrame) -> DataFrame:
    """The nodes that each version adds to the shared tree: doc_id, g, pos of its leaf, level, node."""
    return rows.where("changed is not null").select(
        "doc_id", "g", "pos", F.posexplode("copied").alias("level", "node"))


def proof_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, a digest of the proof, the folded root, whether it holds."""
    siblings = F.concat_ws("", F.transform("path", lambda step: F.substring(step, 2, 64)))
    folded = F.element_at("copied", -1)
    return manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256)
        .alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"))
