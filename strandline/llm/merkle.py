"""Merkle manifest of a dataset as a persistent tree with path copying (operator 13).

Every row is a leaf.  The leaves of a source, by id, are taken in runs of FAN up
to a subroot, and the subroots of all sources, by name, likewise to the root.  A
row that was tampered with makes a version of the tree: it copies the ancestors
of its leaf and shares all other nodes, so a version costs one path, and many
versions stand side by side on one tree.

The tree is cut into aligned blocks of FAN ** 2 leaves.  A block is built, and
the paths in it are copied, in one task; above the blocks a level is a
shuffle of digests, FAN times fewer each time.  Going down again, every block is
told the siblings on its way to the root, and its versions go on from the block's
top with these: the upper nodes of a version are made in the tasks of the
blocks, whatever the number of versions.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, saved, split_lookup

FAN, BLOCK_LEVELS = 16, 2
BLOCK = FAN**BLOCK_LEVELS
#: One row in so many is tampered with in the query.
TAMPER_EVERY = 5
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEPS = "array<struct<before:string,after:string>>"
_COPIES = "array<struct<level:int,index:bigint,digest:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the columns one after the other: a dash for null, else the bytes of the value in UTF-8, a colon, the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def height(n: int) -> int:
    """Levels above n nodes up to a single one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grown(leaves: list[str], levels: int) -> list[list[str]]:
    """The nodes over some leaves, level by level; the last run of a level may be short."""
    nodes = [leaves]
    for _ in range(levels):
        below = nodes[-1]
        nodes.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return nodes


def steps(nodes: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after the nodes on the way from a leaf to the top, by level."""
    out = []
    for below in nodes[:-1]:
        run = at - at % FAN
        out.append(("".join(below[run:at]), "".join(below[at + 1 : run + FAN])))
        at //= FAN
    return out


def copied(leaf: str, way: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version with this leaf has of its own, from the leaf to the top; it shares all others."""
    path = [leaf]
    for before, after in way:
        path.append(digest(before, path[-1], after))
    return path


def _tops(rows: pa.Table) -> pa.Table:
    """The top of one block."""
    rows = rows.sort_by("place")
    n = rows["n"][0].as_py()
    levels = min(height(n), BLOCK_LEVELS)
    top = grown(rows["leaf"].to_pylist(), levels)[-1][0]
    return pa.table({"g": rows["g"][:1], "i": rows["block"][:1], "n": [-(-n // BLOCK)], "digest": [top]})


def _verified(rows: pa.Table, upper: pa.Table) -> pa.Table:
    """The leaves of one block with proofs and versions; upper: one row, the block's way to the root."""
    rows = rows.sort_by("place")
    leaves, changed, doc_ids = (rows[c].to_pylist() for c in ("leaf", "changed", "doc_id"))
    way = upper.to_pylist()[0]
    above, below_root = [(s["before"], s["after"]) for s in way["steps"]], way["source_levels"]
    nodes = grown(leaves, min(height(rows["n"][0].as_py()), BLOCK_LEVELS)) if leaves else []
    first = rows["place"][0].as_py() if leaves else 0
    out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "copies")}
    for at, (leaf, new) in enumerate(zip(leaves, changed, strict=True)):
        whole = steps(nodes, at) + above
        path = copied(leaf if new is None else new, whole)
        out["proof_sha256"].append(digest(*(s for step in whole for s in step)))
        out["folded_root"].append(path[-1])
        index, copies = first + at, []
        for level, d in enumerate(path):
            if level == below_root:  # from the source's own tree to the place of its subroot
                index = way["source_place"]
            copies.append({"level": level, "index": index, "digest": d})
            index //= FAN
        out["copies"].append(None if new is None else copies)
    n = len(leaves)
    out |= {"doc_id": doc_ids, "leaf": leaves, "subroot": [way["subroot"]] * n, "root": [way["root"]] * n}
    copy = pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]))
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in list(out)[1:-1]), ("copies", copy)]))


def climb(nodes: DataFrame) -> DataFrame:
    """g, i, steps, top: the way of each node (g, i, n, digest) up to the single node of its group; n: nodes of the group.

    A level up is one grouping by run; the way down joins each run with its
    parent's.  Groups end at levels of their own.
    """
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    now = nodes
    for _ in range(height(most)):
        runs = now.where("n > 1").groupBy("g", F.floor(F.col("i") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("run"), F.max("n").alias("n"))
        levels.append(saved(runs, "runs"))
        now = levels[-1].select("g", F.col("up").alias("i"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256).alias("digest"))
    single = lambda d: d.where("n = 1").select("g", "i", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("top"))
    way = single(now)
    for k in range(len(levels) - 1, -1, -1):
        each = levels[k].select("g", "up", F.col("run"), F.posexplode("run").alias("j", "x"))
        part = lambda first, n: F.array_join(F.transform(F.slice("run", first, n), lambda x: x["digest"]), "")
        each = each.select("g", "up", F.col("x.i").alias("i"), F.struct(part(1, F.col("j")).alias("before"), part(F.col("j") + 2, F.lit(FAN)).alias("after")).alias("step"))
        up = each.join(way.withColumnRenamed("i", "up"), ["g", "up"]).select("g", "i", F.concat(F.array("step"), "steps").cast(_STEPS).alias("steps"), "top")
        below = nodes if k == 0 else levels[k - 1].select("g", F.col("up").alias("i"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256).alias("digest"))
        way = saved(up.union(single(below)), "ways")
    return way


def merkle(docs: DataFrame, tampered: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, copies, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  tampered
    says which rows were tampered with (by default one in TAMPER_EVERY, by the
    crc32 of the id) and changed_text what their text is now (by default A-Z in
    lower case); copies are the nodes that their version of the tree has of its
    own (level 0: the leaf), null for others.  folded_root is the root of the
    row's version, or, of others, what its leaf and siblings give again.

    A null source is a source, the first one; null ids come first in a source and
    count as an empty text for crc32; rows that share an id go by their leaf, so
    that rows alike are interchangeable.  A null text stays null when tampered with.
    Other columns are ignored; an empty table gives no rows.
    """
    c = lambda name: F.col(name)
    if tampered is None:
        tampered = F.crc32(F.coalesce(c("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPER_EVERY == 0
    changed_text = F.translate(c("text"), *_LOWER) if changed_text is None else changed_text
    fields = lambda text: (c("doc_id").cast("long"), c("source"), c("lang"), c("n_chars").cast("long"), text)
    group = F.coalesce(F.concat(F.lit("="), c("source").cast("string")), F.lit(""))  # not null, in the order of sources
    leaves = docs.select(c("doc_id").cast("long").alias("doc_id"), group.alias("g"), leaf_digest(*fields(c("text"))).alias("leaf"), F.when(tampered, leaf_digest(*fields(changed_text))).alias("changed"))
    leaves = saved(numbered(leaves, ["doc_id", "leaf", "changed"], "g").withColumn("block", F.floor(c("place") / BLOCK)), "leaves")
    blocks = saved(leaves.select("g", "block", "place", "n", "leaf").groupBy("g", "block").applyInArrow(_tops, "g string, i bigint, n bigint, digest string"), "blocks")
    in_source = climb(blocks)
    subroots = saved(numbered(in_source.where("i = 0").select("g", c("top").alias("subroot"), F.size("steps").alias("own_levels")), ["g"]), "subroots")
    to_root = climb(subroots.select(F.lit("").alias("g"), c("place").alias("i"), "n", c("subroot").alias("digest")))
    # where a source's own tree ends: its blocks' levels, as far as it has them, and those above
    in_block = F.when(c("leaves") <= 1, 0).when(c("leaves") <= FAN, 1).otherwise(BLOCK_LEVELS)
    sizes = leaves.where("place = 0").select("g", c("n").alias("leaves"))
    of_source = subroots.join(to_root.select(c("i").alias("place"), c("steps").alias("to_root"), c("top").alias("root")), "place").join(sizes, "g")
    of_source = saved(of_source.select("g", "subroot", "root", "to_root", c("place").alias("source_place"), (in_block + c("own_levels")).cast("int").alias("source_levels")), "sources")
    ways = split_lookup(in_source.select("g", c("i").alias("block"), "steps"), of_source, "g", "block")
    ways = saved(ways.select("g", "block", F.concat("steps", "to_root").alias("steps"), "subroot", "root", "source_place", "source_levels"), "ways")
    schema = f"doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copies {_COPIES}"
    return leaves.groupBy("g", "block").cogroup(ways.groupBy("g", "block")).applyInArrow(_verified, schema).withColumn("verified", c("folded_root") == c("root"))


def versions(manifest: DataFrame) -> DataFrame:
    """doc_id, level, index, digest: the nodes that the versions of a manifest have of their own; indexes count within the source up to its subroot, and from there over all sources."""
    return manifest.where("copies is not null").select("doc_id", F.inline("copies"))
