"""MinHash near-dedup by a signature-coordinate inverted join (operator 3).

Each document's set of word shingles gets a signature of COORDINATES values.
Documents with equal sets form a class, which is posted once under each of its
(coordinate, value) tokens.  Two classes with a similarity at the threshold
share a token in most coordinates, so a pair must collide LEAST times: if a
class orders its tokens from rare to frequent and leaves out the LEAST - 1 most
frequent, such pairs still meet under one of the rest (prefix).  Tokens that no
other class has drop out first, and with them most classes.

Pairs are not spelled out inside a token's list.  Each class is compared with
the most central one of the list, whose tokens are the most frequent: among near
copies, the one most like the original.  Classes whose lists still hold more
than one component are compared in cells of bounded size, which return links
between components only.  Collisions of a pair
are counted over whole signatures (the tokens that the prefix skipped), and
pairs with LEAST or more are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import components, parts, saved, split_join, split_lookup

COORDINATES = 64
#: At a similarity of 0.8, 51.2 of 64 coordinates agree; fewer than 36 do in about 1 of 500,000 pairs.
LEAST = 36
#: Members of a cluster's chunk; a cell compares two chunks.
CHUNK = 512
_SIGNATURE = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, tokens array<bigint>"


def _signatures(k: int, coordinates: int):
    a = W.mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    b = W.mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    high = np.arange(coordinates, dtype=np.int64) << 56

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole):
                value, first = W.shingles(batch.column("text"), k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                at = first[:-1][full]
                tokens = np.zeros((len(full), coordinates), np.int64)
                sums = np.zeros((2, len(n)), np.int64)
                if len(full):
                    for j in range(coordinates):
                        x = (value ^ b[j]) * a[j]
                        x ^= x >> np.uint64(29)
                        x *= np.uint64(0xBF58476D1CE4E5B9)
                        tokens[:, j] = high[j] | (np.minimum.reduceat(x, at) >> np.uint64(8)).astype(np.int64)
                    for j in range(2):
                        sums[j, full] = np.add.reduceat(W.mix(value ^ b[j]), at).view(np.int64)
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, coordinates, 0), out=offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.ravel()))], names=["doc_id", "n_shingles", "set_a", "set_b", "tokens"])

    return of


def _overlap(k: int):
    @F.arrow_udf("bigint")
    def shared(left: pa.Array, right: pa.Array) -> pa.Array:
        """Shingles that the two texts of a row share."""
        step, out = 500, []
        for i in range(0, len(left), step):
            (v, f), (w, g) = W.shingles(left.slice(i, step), k), W.shingles(right.slice(i, step), k)
            rows = len(f) - 1
            doc = np.concatenate([np.repeat(np.arange(rows), np.diff(f)), np.repeat(np.arange(rows), np.diff(g))])
            value = np.concatenate([v, w])
            order = np.lexsort((value, doc))
            same = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            out.append(np.bincount(doc[order][1:][same], minlength=rows))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return shared


def near_classes(docs: DataFrame, k: int = 4, percent: int = 80, coordinates: int = COORDINATES, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles and component_id, the smallest doc_id that its links reach.

    Documents are linked if 100 * shared shingles >= percent * shingles of both.
    Null, empty and wordless texts have no shingles, and are linked with nothing:
    component_id is their own id.  Rows with a null id are linked with nothing
    either, and have a null component_id.  Rows that share an id are versions of
    one document, whose links are those of all versions.  Equal sets count as
    linked without comparison.  Other columns are ignored; an empty table gives
    no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = saved(own.mapInArrow(_signatures(k, coordinates), _SIGNATURE), "signatures")
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    classes = saved(sets.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("tokens", "doc_id").alias("tokens")), "classes")

    # rare tokens first; those of one class only can't be shared
    posted = classes.select("rep", "n_shingles", F.explode("tokens").alias("token"))
    common = posted.groupBy("token").agg(F.count(F.lit(1)).alias("often"), parts("rep")).where("often > 1")
    listed = split_join(posted, common, "token", "rep").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("list")).where(F.size("list") >= least)
    central = F.aggregate("list", F.lit(0).cast("long"), lambda s, x: s + x["often"])
    prefix = saved(listed.select("rep", "n_shingles", central.alias("central"), F.explode(F.expr(f"slice(list, 1, size(list) - {least - 1}).token")).alias("token")), "prefix")
    texts = saved(own.join(prefix.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    hubs = prefix.groupBy("token").agg(F.max(F.struct("central", -F.col("rep"), "rep", F.col("n_shingles").alias("m_shingles"))).alias("hub"), parts("rep"))
    near = f"100 * least(n_shingles, hub.m_shingles) >= {percent} * greatest(n_shingles, hub.m_shingles)"
    pairs = split_join(prefix, hubs, "token", "rep").where("rep <> hub.rep and " + near).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
    links = saved(_confirmed(saved(pairs, "pairs"), classes, texts, k, percent, least), "links")
    apart = _open(prefix, components(links))
    part = components(links.union(saved(_rest(saved(apart, "lists"), classes, texts, k, percent, least), "links")))
    named = classes.join(part, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    linked = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def _open(prefix: DataFrame, part: DataFrame) -> DataFrame:
    """The lists with members of more than one component."""
    split = prefix.join(part, F.col("rep") == F.col("node"), "left").select("token", "rep", F.coalesce("component", "rep").alias("component"))
    apart = split.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), parts("rep")).where("x <> y").select("token", "__parts")
    return split_join(split, apart, "token", "rep")


def _rest(lists: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Links between components that share a list.

    Lists with common members are one cluster.  Its members are dealt into
    chunks of at most about CHUNK, and each two chunks meet in a cell, which
    compares signatures, then whole sets, of members of different components,
    and returns the links only.  Small clusters share cells.
    """
    first = lists.groupBy("token").agg(F.min("rep").alias("b"), parts("rep"))
    cluster = components(split_join(lists, first, "token", "rep").select(F.col("rep").alias("a"), "b")).withColumnsRenamed({"node": "rep", "component": "cluster"})
    members = saved(lists.select("rep", "component").distinct().join(cluster, "rep"), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    shared = max(16, -(-members.count() // (4 * CHUNK)))
    dealt = members.join(sizes, "cluster").withColumn("chunk", F.expr("pmod(hash(rep), chunks)")).withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.select("rep", "component", "cluster", "chunk", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), F.when(F.col("chunks") == 1, F.expr(f"pmod(hash(cluster), {shared})")).otherwise(-1).alias("bucket"))
    dealt = dealt.withColumn("cell", F.when(F.col("bucket") < 0, F.col("cluster")).otherwise(-1))
    rows = dealt.join(classes.groupBy("rep").agg(F.max("tokens").alias("tokens")), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        value, first = W.shingles(table.column("text").combine_chunks(), k)
        tokens = table.column("tokens").combine_chunks().values.to_numpy().reshape(table.num_rows, -1)
        rep, component, cluster, chunk = (table.column(c).to_numpy() for c in ("rep", "component", "cluster", "chunk"))
        crossed = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        n, found = np.diff(first), []
        order = np.argsort(cluster, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            root = component[group].copy()
            for at, i in enumerate(group[:-1]):
                later = group[at + 1 :]
                open_to = root[at + 1 :] != root[at]
                if crossed:
                    open_to &= chunk[later] != chunk[i]
                open_to &= 100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i])
                near = later[open_to]
                near = near[(tokens[near] == tokens[i]).sum(1) >= least]
                if not len(near):
                    continue
                mine = value[first[i] : first[i + 1]]
                theirs = np.concatenate([value[first[j] : first[j + 1]] for j in near])
                hit = np.searchsorted(mine, theirs)
                same = mine[np.minimum(hit, len(mine) - 1)] == theirs
                both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(n[near])[:-1]]), dtype=np.int64)
                for j in near[100 * both >= percent * (n[i] + n[near] - both)]:
                    other = root[group == j][0]
                    if other != root[at]:  # one link between two components will do
                        root[root == other] = root[at]
                        found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("cell", "bucket", "lo", "hi").applyInArrow(compare, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, own: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `least` coordinates, and whose whole sets are near enough.

    A central document has many pairs; they are dealt into parts, each with a copy of its text.
    """
    a = classes.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"), F.col("n_shingles").alias("na"))
    b = classes.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"), F.col("n_shingles").alias("nb"))
    agree = F.aggregate(F.zip_with("ta", "tb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = split_lookup(split_lookup(pairs, a, "a", "b"), b, "b", "a")
    close = saved(met.where(agree >= least).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb")), "close")
    sides = close.select("a", "b", "na", "nb", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("doc_id")), F.struct(F.lit(1).alias("side"), F.col("b").alias("doc_id")))).alias("s")).select("a", "b", "na", "nb", "s.*")
    texts = split_lookup(sides, own.where("doc_id is not null"), "doc_id", "a", "b").groupBy("a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("right"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return texts.withColumn("both", _overlap(k)("left", "right")).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def minhash_dedup(docs: DataFrame, k: int = 5, percent: int = 80, **more: object) -> DataFrame:
    """near_classes with kept: true for the smallest id of each component, and for rows without an id."""
    return near_classes(docs, k, percent, **more).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
