"""A Merkle tree over the documents of every language, with inclusion proofs and their check.

A row's place in its group comes from one range-partitioned sort and the sizes of the parts before its
own, so no group is ordered in one task. A level is a window over (group, parent): the ordered full frame
collects the digests of a run of ``FAN`` neighbours, which are both the preimage of their parent and
each other's siblings; the parents, one row of each run, are the next level, an eighth as long. The roots
of the groups, in the groups' order, are the leaves of one more tree of the same kind. Going back down,
every node takes its parent's path and adds its own run, so a leaf ends with the siblings of all its
ancestors, read from a table that is an eighth as long as the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.scratch import Scratch

#: Neighbours that become one parent.
FAN = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_PATH = "array<struct<run:array<string>,at:int>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with pos, the place (from 0) in the rows of one ``g`` by ``order``, and n, how many rows ``g`` has.

    Rows are written in the order of (g, order) and numbered by part and place in it. What a group has in
    earlier parts is a running sum over the parts it stands in.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    kept = scratch.save(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("part", F.shiftright("at", 33))
    parts = kept.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    parts = scratch.save(parts, f"{name}-parts")
    return kept.join(parts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def parents(nodes: DataFrame) -> DataFrame:
    """(g, pos, n, digest, run) of the next level: one row of each run of FAN nodes, in groups of more than one node."""
    at = nodes.where("n > 1").select("g", "pos", "n", "digest", F.expr(f"pos div {FAN}").alias("parent"))
    run = Window.partitionBy("g", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ran = at.withColumn("run", F.collect_list("digest").over(run)).where(F.col("pos") % FAN == 0)
    return ran.select("g", F.col("parent").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("digest"), "run")


def levels(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels above ``nodes``, each a written table, up to the one where every group has one node."""
    most, above = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        nodes = scratch.save(parents(nodes), f"{name}-{len(above) + 1}")
        above.append(nodes)
        most = -(-most // FAN)
    return above


def tops(nodes: list[DataFrame]) -> DataFrame:
    """(g, digest): the last node of each group."""
    found = [x.where("n = 1").select("g", "digest") for x in nodes]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def with_paths(nodes: list[DataFrame], start: DataFrame) -> DataFrame:
    """The first level with path: the run of every ancestor's children and the place in it, from the leaf up.

    ``start`` (g, path, ...) holds what lies above the groups' last nodes; its other columns come along.
    """
    extra = [c for c in start.columns if c not in ("g", "path")]
    above = None
    for level in reversed(nodes):
        own = [c for c in level.columns if c != "run"]
        here = level.where("n = 1").join(start, "g").select(*own, "path", *extra, *(["run"] if "run" in level.columns else []))
        if above is not None:
            step = F.struct(F.col("up_run").alias("run"), (F.col("pos") % FAN).cast("int").alias("at"))
            up = above.select("g", F.col("pos").alias("parent"), F.col("run").alias("up_run"), F.col("path").alias("up_path"), *extra)
            child = level.where("n > 1").withColumn("parent", F.expr(f"pos div {FAN}")).join(up, ["g", "parent"])
            child = child.withColumn("path", F.concat(F.array(step), "up_path")).select(here.columns)
            here = child.unionByName(here)
        above = here
    return above


def siblings(step: Column) -> Column:
    """The digests of a step's run but the one at its place, left to right."""
    return F.concat(F.slice(step["run"], F.lit(1), step["at"]), F.slice(step["run"], step["at"] + 2, F.lit(FAN)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""

    def up(digest: Column, step: Column) -> Column:
        run = F.concat(F.slice(step["run"], F.lit(1), step["at"]), F.array(digest), F.slice(step["run"], step["at"] + 2, F.lit(FAN)))
        return F.sha2(F.array_join(run, ""), 256)

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    A leaf is the hash of doc_id, source, lang, n_chars and text, framed by their lengths, nulls apart
    from empty values. Leaves ascend by doc_id within a lang, null ids first; rows that share an id
    ascend by their leaf, and equal rows are alike. A null lang is a group of its own, the first. One
    third of the ids are tampered with (A-Z of the text lower-cased) after the tree is built, and
    ``verified`` tells whether the leaf as it then is still folds to the root; a null id is left alone.
    A lone leaf of a lang is its subroot, and a lone lang's subroot the root; without siblings the proof
    is the hash of nothing. Texts of any length are read once, by the leaf; extra columns are ignored,
    and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(tampered, leaf(*fields, F.translate("text", _UPPER, _LOWER)))
    # the key of a group sorts as its lang does, null first
    group = F.when(F.col("lang").isNull(), F.lit("+")).otherwise(F.concat(F.lit("-"), F.col("lang")))
    leaves = docs.select("doc_id", group.alias("g"), leaf(*fields, F.col("text")).alias("digest"), changed.alias("changed"))
    leaves = scratch.save(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = scratch.save(placed(leaves, ["doc_id", "digest", "row"], scratch, "sorted").drop("row"), "placed")
    tree = [leaves, *levels(leaves, scratch, "level")]
    subroots = scratch.save(tops(tree).select(F.lit("").alias("g"), F.col("g").alias("lang_key"), "digest"), "subroots")
    subroots = scratch.save(placed(subroots, ["lang_key"], scratch, "sorted-subroots"), "placed-subroots")
    crown = [subroots, *levels(subroots, scratch, "crown")]
    root = tops(crown).select("g", F.col("digest").alias("root"), F.array().cast(_NO_PATH).alias("path"))
    start = with_paths(crown, root).select(F.col("lang_key").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    rows = with_paths(tree, scratch.save(start, "start"))
    proof = F.sha2(F.array_join(F.flatten(F.transform("path", siblings)), ""), 256)
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(depth: int = 8) -> str:
    """DuckDB SQL for ``manifest``, unrolled for groups of at most FAN**depth leaves."""

    def frame(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END"

    def leaf_of(text: str) -> str:
        return "sha256(concat(" + ", ".join([*map(frame, ("doc_id", "source", "lang", "n_chars")), frame(text)]) + "))"

    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
    )
    steps = [
        f"l AS (SELECT doc_id, lang, {leaf_of('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf_of(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l)",
        "a0 AS (SELECT lang AS g, pos, n, leaf AS digest FROM t0)",
    ]

    def grow(prefix: str) -> None:
        for k in range(depth):
            steps.append(f"{prefix}r{k} AS (SELECT g, pos // {FAN} AS parent, list(digest ORDER BY pos) AS run, n FROM {prefix}{k} GROUP BY g, pos // {FAN}, n)")
            steps.append(f"{prefix}{k + 1} AS (SELECT g, parent AS pos, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {prefix}r{k})")

    def climb(prefix: str, source: str, key: str, to: str) -> None:
        for k in range(depth):
            steps.append(
                f"{to}{k + 1} AS (SELECT x.* EXCLUDE (folded, proof, pos), x.pos // {FAN} AS pos, "
                f"CASE WHEN r.n = 1 THEN folded ELSE sha256(array_to_string(list_concat(run[1:x.pos % {FAN}], [folded], run[x.pos % {FAN} + 2:]), '')) END AS folded, "
                f"CASE WHEN r.n = 1 THEN proof ELSE concat(proof, array_to_string(list_concat(run[1:x.pos % {FAN}], run[x.pos % {FAN} + 2:]), '')) END AS proof "
                f"FROM {source if not k else f'{to}{k}'} x JOIN {prefix}r{k} r ON r.g IS NOT DISTINCT FROM x.{key} AND r.parent = x.pos // {FAN})"
            )

    grow("a")
    steps.append("b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest, g AS lang FROM " + f"a{depth})")
    grow("b")
    steps.append("s0 AS (SELECT doc_id, lang, leaf, pos, coalesce(changed, leaf) AS folded, '' AS proof FROM t0)")
    climb("a", "s0", "lang", "s")
    steps.append(f"u0 AS (SELECT doc_id, leaf, folded, proof, 0 AS one, b0.pos AS pos, b0.digest AS subroot FROM s{depth} s JOIN b0 ON b0.lang IS NOT DISTINCT FROM s.lang)")
    climb("b", "u0", "one", "u")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified FROM u{depth} CROSS JOIN b{depth} r"
    )
