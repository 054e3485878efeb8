"""N-gram Jaccard join (operator 9): chosen-path similarity join.

A document is its set of five-word shingles; texts of one to four words have
one shingle.  Documents with equal sets form a class and go on as one row.
In each of several runs a set walks down a tree: at every level each token of
the set is chosen with probability 1 / (threshold * |set|) by a hash of run,
path and token, and each chosen token opens a child.  Two sets meet in a node
if they chose the same tokens, which similar ones do with a probability that
falls with the depth as about 1 / depth, and others with one that falls
exponentially.

Every path goes ``depth`` levels down.  A node that then holds more than
``block`` sets is split again, and so are its children, up to ``more`` levels,
at which ``rate`` times as many tokens are chosen, so that pairs at the threshold
hardly get lost.  The sets of all members are written once, dealt by id, so that
no level shuffles them again, but only ids and nodes.  Documents that only share a common passage (less than threshold
/ rate, or two fifths, of their shingles) part again so, however many they are.
A node whose children hold more pairs than itself is not split, since its members
are alike.  Runs repeat until the miss probability at the threshold is below
``1 - recall``, all levels included.  Sets
that meet in a last node form a bucket; its pairs are compared exactly, by
counting common tokens.

Nodes with equal members are compared once.  A bucket of more than ``block``
sets is cut into blocks, and block meets block in a task each, so no task is
unbounded; that happens where very many sets are alike, whose links have to be
counted one by one.  A pair that meets in several buckets is counted in the one
with the smallest number only; each set reports its links and the smallest
member of its part of the bucket, never the pairs, so rows out are in proportion
to rows in.  Classes of linked documents are then found by label propagation.

Cases: documents without a word, null or empty, link to nothing, nor do rows
without doc_id; equal rows of one doc_id are one document, and different texts of
one doc_id are compared each by itself: no link of any is lost, the document's
links are their sum, and it joins the classes that its texts are in; ids are
integers; an empty table gives an empty result; a text of any length is read
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.order import positions
from ._spark import bucketed, durable, shards
from ._text import mix, shingle_sets, slices, utf8


@dataclass(frozen=True)
class Settings:
    k: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    depth: int = 2
    block: int = 512
    more: int = 8
    #: Sets in one part of the table of sets, about.
    part: int = 20_000
    rate: float = 2.0

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold has met with probability ``recall``, whatever the levels it goes through.

        A pair at the threshold shares at least 1 chosen token a level on average (``rate`` where nodes are split
        again), so its chance p to survive one more level is at least 1 - exp(-p) of the chance below.
        """
        p = 1.0
        for _ in range(self.more):
            p = 1 - math.exp(-self.rate * p)
        for _ in range(self.depth):
            p = 1 - math.exp(-p)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - p))


def limits(size: np.ndarray, rate: float, s: Settings) -> np.ndarray:
    """What the upper 53 bits of a token's hash must be below for it to be chosen, by the size of its set."""
    return (np.minimum(1.0, rate / (s.threshold * np.maximum(size, 1))) * float(1 << 53)).astype(np.uint64)


def children(g: np.ndarray, off: np.ndarray, row: np.ndarray, path: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the node, row, child) of all children of the nodes (row, path)."""
    count = np.diff(off)[row]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    node = np.repeat(np.arange(len(row)), count)
    u = mix(g[np.repeat(off[row], count) + inner] ^ path[node])
    keep = (u >> np.uint64(11)) < limit[row[node]]
    return node[keep], row[node[keep]], mix(u[keep] + path[node[keep]])


def paths(g: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of all nodes at level ``depth`` that the sets of a slice reach."""
    size = np.diff(off)
    limit, token_row = limits(size, 1.0, s), np.repeat(np.arange(len(size)), size)
    rows, nodes = [], []
    for r in range(s.runs):
        seed = mix(np.array([r + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        u = mix(g ^ seed)  # the first level, of which every token takes part
        keep = (u >> np.uint64(11)) < limit[token_row]
        row, path = token_row[keep], mix(u[keep] + seed)
        for _ in range(1, s.depth):
            _, row, path = children(g, off, row, path, limit)
        rows.append(row)
        nodes.append(path)
    return np.concatenate(rows), np.concatenate(nodes)


def _set_key(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mix(g ^ np.uint64(0xA5A5A5A5)), out=total[1:])
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64))


def _grouped(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """A list of the distinct values of each row."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if len(row):
        keep = np.r_[True, (values[1:] != values[:-1]) | (row[1:] != row[:-1])]
        values, row = values[keep], row[keep]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """id, set_key and nodes of every document with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                g, off = shingle_sets(*utf8(batch.column("text")), s.k)
                row, node = paths(g, off, s)
                out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_set_key(g, off).view(np.int64)), _grouped(node, row, batch.num_rows)], names=["id", "set_key", "nodes"])
                yield out.filter(pa.array(np.diff(off) > 0))

    return docs.mapInArrow(run, "id long, set_key long, nodes array<long>")


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    """rep and its shingles; ``docs`` has one row for each class that meets another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                g, off = shingle_sets(*utf8(batch.column("text")), s.k)
                # packed, so that rows are copied as they are instead of value by value
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(g))])
                yield pa.RecordBatch.from_arrays([batch.column("id"), packed], names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles binary")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    size = np.concatenate([np.diff(np.asarray(c.offsets)) for c in column.chunks]) if column.num_chunks else np.zeros(0, np.int64)
    values = [np.asarray(c.flatten()) for c in column.chunks]
    return np.concatenate(values) if values else np.zeros(0, np.int64), np.r_[0, np.cumsum(size)]


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of packed 64-bit values."""
    rows = [np.frombuffer(x.as_buffer(), np.int64) for c in column.chunks for x in c]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int64)


def common(values: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n lists have in common (float32, exact below 2**24)."""
    who = np.repeat(np.arange(n), np.diff(off))
    distinct, at, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    number = np.cumsum(count > 1) - 1
    at, who = number[at[shared]], who[shared]
    width, out = int((count > 1).sum()), np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for begin in range(0, width, 4096):
        lo, hi = np.searchsorted(at, [begin, begin + 4096])
        m = np.zeros((n, min(4096, width - begin)), np.float32)
        m[who[lo:hi], at[lo:hi] - begin] = 1
        out += m @ m.T
    return out


def compare(bucket: int, i: int, j: int, rep: np.ndarray, part: np.ndarray, copies: np.ndarray, sets: tuple, buckets: tuple, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the members that link to others in this bucket, or in blocks i and j of it."""
    n = len(rep)
    size = np.diff(sets[1]).astype(np.float64)
    both = common(*sets, n).astype(np.float64)
    near = both >= s.threshold * (size[:, None] + size[None] - both) - 1e-6  # whole numbers, but for the threshold
    np.fill_diagonal(near, False)
    if i != j:
        near &= part[:, None] != part[None]
    # pairs that share a bucket of a smaller number are counted there
    values, off = buckets
    who = np.repeat(np.arange(n), np.diff(off))
    smaller = values < bucket
    if smaller.any():
        sub = np.bincount(who[smaller], minlength=n)
        near_before = common(values[smaller], np.r_[0, np.cumsum(sub)], n) > 0
        counted = near & ~near_before
    else:
        counted = near
    links = counted @ copies
    root = np.arange(n)
    while True:
        reach = np.where(near, root[None], n).min(axis=1, initial=n)
        new = np.minimum(root, reach)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = near.any(axis=1)
    return rep[linked], links[linked], rep[root[linked]]


def _met(members: DataFrame) -> DataFrame:
    """bucket, n of all nodes of (rep, node) with two members or more; one of those with equal members."""
    member = F.xxhash64("rep")
    nodes = members.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.sum((member % (1 << 30)).cast("long")).alias("y")).where("n > 1")
    return nodes.groupBy("n", "x", "y").agg(F.min("node").alias("bucket")).select("bucket", "n")


def _split(g: pa.ChunkedArray, parents: pa.ChunkedArray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, parent, child) of all children of the nodes that each packed set is in."""
    (values, off), (nodes, node_off) = _unpacked(g), _flat(parents)
    row, path = np.repeat(np.arange(len(off) - 1), np.diff(node_off)), nodes.view(np.uint64)
    at, row, child = children(values.view(np.uint64), off, row, path, limits(np.diff(off), s.rate, s))
    return row, nodes[at], child.view(np.int64)


def _children(sets: DataFrame, s: Settings) -> DataFrame:
    """rep, parent, node of ``sets`` (rep, shingles, parents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # as many sets at once as have a million tokens to look at, over all their nodes
            work = np.cumsum([len(x.as_buffer()) // 8 * len(p) for x, p in zip(whole.column("shingles"), whole.column("parents"), strict=True)])
            cuts = [*np.flatnonzero(np.r_[True, work[1:] >> 20 != work[:-1] >> 20]).tolist(), whole.num_rows] if whole.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(a, b - a)
                row, parent, child = _split(pa.chunked_array([batch.column("shingles")]), pa.chunked_array([batch.column("parents")]), s)
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(row)), pa.array(parent), pa.array(child)], names=["rep", "parent", "node"])

    return sets.mapInArrow(run, "rep long, parent long, node long")


def split_large(inside: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """``inside`` (rep, bucket, n) with its large buckets split along further levels of the tree, where that parts their members.

    ``sets`` has the packed set (rep, shingles) of every member.
    """
    for _ in range(s.more):
        large = inside.where(F.col("n") > s.block)
        if large.isEmpty():
            break
        parents = durable(large.groupBy("rep").agg(F.collect_list("bucket").alias("parents")))
        found = durable(_children(sets.join(parents, "rep"), s))
        # a node whose children hold more pairs than itself is done: its members are alike
        pairs = found.groupBy("parent", "node").agg(F.count("*").cast("double").alias("n")).where("n > 1").groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        sizes = large.groupBy("bucket").agg(F.max("n").cast("double").alias("n"))
        parted = durable(sizes.join(pairs, F.col("bucket") == F.col("parent"), "left").where(F.coalesce("pairs", F.lit(0.0)) <= F.col("n") * F.col("n")).select("bucket"))
        if parted.isEmpty():
            break
        below = found.join(parted, F.col("parent") == F.col("bucket"), "left_semi")
        inside = durable(
            inside.join(parted, "bucket", "left_anti").select("rep", "bucket", "n")
            .unionByName(below.select("rep", F.col("node").alias("bucket")).join(_met(below), "bucket").select("rep", "bucket", "n"))
        )
    return inside


def _links(sets: DataFrame, inside: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """rep, links, root for every bucket, or two blocks of one, in which a member links to others."""
    lists = inside.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("sizes"))
    rows = sets.join(lists.join(classes.select("rep", "copies"), "rep"), "rep")

    blocks = F.ceil(F.col("n") / s.block).cast("int")
    part = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    work = (
        rows.select("rep", "copies", "shingles", "buckets", F.explode(F.arrays_zip("buckets", "sizes")).alias("b"))
        .select("rep", "copies", "shingles", "buckets", F.col("b.buckets").alias("bucket"), F.col("b.sizes").alias("n"))
        .withColumn("blocks", blocks).withColumn("part", part)
        # block p takes part in the tasks (p, p), (p, q) and (q, p) with q above and below
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        .drop("n", "blocks", "other")
    )

    def run(table: pa.Table) -> pa.Table:
        rep = np.asarray(table.column("rep"))
        order = np.argsort(rep)
        table, rep = table.take(pa.array(order)), rep[order]
        found = compare(
            table.column("bucket")[0].as_py(), table.column("i")[0].as_py(), table.column("j")[0].as_py(), rep, np.asarray(table.column("part")),
            np.asarray(table.column("copies")), _unpacked(table.column("shingles")), _flat(table.column("buckets")), s,
        )
        return pa.table({"rep": pa.array(found[0], pa.int64()), "links": pa.array(found[1], pa.int64()), "root": pa.array(found[2], pa.int64())})

    return work.groupBy("bucket", "i", "j").applyInArrow(run, "rep long, links long, root long")


def _by_row(known: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """id, class_id (smallest id of its class), n_links for ``known`` (id, text), whose ids are unique; ``sketches`` are theirs."""
    classes = durable(sketches.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("nodes").alias("nodes")))

    met = classes.select("rep", F.explode("nodes").alias("node"))
    inside = durable(met.withColumnRenamed("node", "bucket").join(_met(met), "bucket").select("rep", "bucket", "n"))

    members = inside.select("rep").distinct()
    parts = shards(known, s.part, members.count())
    texts = known.repartition(parts, "id").join(members.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi")
    with bucketed(_sets(texts, s), "rep", parts) as sets:
        found = durable(_links(sets, split_large(inside, sets, s), classes, s))
    labels = components(found.where("rep <> root").select("rep", "root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = (
        classes.select("set_key", "rep", "copies").join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_key", F.coalesce("label", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return sketches.select("id", "set_key").join(facts, "set_key").select("id", "class_id", "n_links")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _joined(known: DataFrame, s: Settings) -> tuple[DataFrame, bool]:
    """id, class_id, n_links by id and False; where ids repeat, a row for each id and text, with ``sha`` and ``class_sha``, and True."""
    sketches = durable(_sketches(known, s))
    if sketches.groupBy("id").count().where("count > 1").isEmpty():
        return _by_row(known, sketches, s), False
    # numbers in the order of the ids stand for the distinct rows
    told = known.withColumn("sha", _sha(F.col("text")))
    keys = durable(positions(told.select("id", "sha").distinct(), "id", "sha").withColumnRenamed("_at", "key"))
    rows = durable(told.join(keys, ["id", "sha"]).select(F.col("key").alias("id"), "text").dropDuplicates(["id"]))
    found = _by_row(rows, durable(_sketches(rows, s)), s).withColumnRenamed("id", "key")
    first = keys.select(F.col("key").alias("_first"), F.col("id").alias("class_id"), F.col("sha").alias("class_sha"))
    named = keys.join(found.withColumnRenamed("class_id", "_first"), "key", "left")
    # texts without a word are in no class, and no others link to them
    out = named.join(first, "_first", "left").select("id", "sha", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_sha", "sha").alias("class_sha"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return durable(out), True


def jaccard_join(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near-duplicate class) and n_links (other documents at the threshold or above).

    Different texts of one doc_id are rows of their own: all are compared, n_links is the sum over them, and the document
    links what they are in to one class.
    """
    s = s or Settings()
    rows = _rows(docs)
    found, repeated = _joined(rows.where("id is not null"), s)
    if repeated:
        links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
        label = components(found.where("id <> class_id").select("id", "class_id").distinct()).toDF("id", "class_id")
        found = links.join(label, "id", "left")
    return (
        rows.select("id").distinct().join(found.select("id", "class_id", "n_links"), "id", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def one_of_each(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies of others: of each class, those of the smallest doc_id (then of the text with the smallest hash).

    Rows are told apart by doc_id and text, so a text that is nowhere else stays, whatever other rows have its doc_id.
    """
    s = s or Settings()
    found, repeated = _joined(_rows(docs).where("id is not null"), s)
    if not repeated:
        return docs.join(found.where("id <> class_id").select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    gone = found.where((F.col("id") != F.col("class_id")) | (F.col("sha") != F.col("class_sha"))).select(F.col("id").alias("doc_id"), F.col("sha").alias("_rl_sha"))
    return docs.withColumn("_rl_sha", _sha(F.col("text"))).join(gone, ["doc_id", "_rl_sha"], "left_anti").select(*docs.columns)
