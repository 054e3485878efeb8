"""Merkle dataset manifest (operator 11): a sparse forest that partitions fold and a tree reduction merges.

Every row is a leaf, every value of ``tree`` (here: lang) a tree over its rows
in the order of the id, and the roots of the trees are the leaves of one more
tree.  Rows are dealt to ranges of (tree, id), so that each task holds leaves
that stand side by side.  What a task knows of a tree is a ``Fragment``: nodes
by level and index that have no parent yet.  As the number of leaves of a tree
is known, so is the width of every sibling run, and a run becomes its parent as
soon as all of it is in one fragment, the last and shorter run of a level too.
Merging is associative, with the empty fragment as identity: what stays
unresolved depends on the leaves that have been seen alone.

Fragments of ranges are reduced as a tree, ``fan`` at a time; a fragment holds
at most two runs of each level of a tree, and a tree that lies in one range is
resolved there and takes no part.  The rounds are grouped frames, as
``RDD.treeReduce`` would leave only the root: here each round also keeps the
siblings that its nodes have met, from which proofs are put together.  The
driver sees no node.

Cases: null fields are ``-``; a null id comes first; rows of one tree and id are
ordered by their leaf, so equal rows have equal digests whatever their order;
texts are hashed whole, in one pass; a null tree comes before all others; an
empty table gives an empty result; other columns are ignored, whatever their
names.  A range holds about ``per_part`` leaves, without their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import ranged
from ._spark import durable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field ``-`` if null, else its UTF-8 bytes, ``:`` and its value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(one(c.cast("string")) for c in fields)), 256)


def widths(n: int, arity: int) -> list[int]:
    """Nodes of each level over ``n`` leaves, the root's level last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


@dataclass
class Fragment:
    """Nodes of one tree of ``n`` leaves that have no parent yet, by level and index."""

    n: int
    arity: int = 2
    nodes: dict[int, dict[int, str]] = field(default_factory=dict)
    #: The siblings, left to right, of every node that has got its parent here.
    siblings: dict[tuple[int, int], str] = field(default_factory=dict)

    def add(self, level: int, index: int, value: str) -> None:
        self.nodes.setdefault(level, {})[index] = value

    def resolve(self) -> Fragment:
        """Gives every sibling run that is complete its parent, level by level."""
        for level, width in enumerate(widths(self.n, self.arity)[:-1]):
            here = self.nodes.get(level, {})
            for parent in sorted({i // self.arity for i in here}):
                run = range(self.arity * parent, min(self.arity * (parent + 1), width))
                if all(i in here for i in run):
                    values = [here.pop(i) for i in run]
                    self.add(level + 1, parent, digest("".join(values)))
                    for place, i in enumerate(run):
                        self.siblings[level, i] = "".join(values[:place] + values[place + 1 :])
            if not here:
                self.nodes.pop(level, None)
        return self

    def merge(self, other: Fragment) -> Fragment:
        """The fragment of both sets of leaves."""
        out = Fragment(self.n, self.arity, {level: dict(x) for level, x in self.nodes.items()})
        for level, x in other.nodes.items():
            out.nodes.setdefault(level, {}).update(x)
        return out.resolve()

    def climb(self, level: int, index: int) -> tuple[int, int, str]:
        """The node without parent above a node, and the siblings on the way."""
        path = []
        while (level, index) in self.siblings:
            path.append(self.siblings[level, index])
            level, index = level + 1, index // self.arity
        return level, index, "".join(path)


def folded(value: str, index: int, n: int, path: str, arity: int) -> str:
    """The root that a leaf and its siblings give."""
    for width in widths(n, arity)[:-1]:
        place = index % arity
        others = HEX * (min(arity, width - index + place) - 1)
        run, path = path[:others], path[others:]
        value = digest(run[: HEX * place] + value + run[HEX * place :])
        index //= arity
    return value


def _fragments(leaves: pa.Table, starts: pa.Table, arity: int) -> dict[str, tuple[Fragment, int]]:
    """The fragment of each tree of a range, and the index of its first leaf there."""
    out = {t: (Fragment(n, arity), first) for t, first, n in zip(*(starts.column(c).to_pylist() for c in ("tree", "_first", "_n")), strict=True)}
    first_row: dict[str, int] = {}
    for t, row, value in sorted(zip(*(leaves.column(c).to_pylist() for c in ("tree", "_row", "leaf")), strict=True), key=lambda x: x[1]):
        fragment, first = out[t]
        fragment.add(0, first + row - first_row.setdefault(t, row), value)
    for fragment, _ in out.values():
        fragment.resolve()
    return out


_NODE = "_part long, tree string, _n long, level int, at long, value string, is_root boolean"


@dataclass
class Forest:
    """Leaves by range, and for each node that a range leaves unresolved its way up."""

    leaves: DataFrame  # _part, _row, tree, leaf and what the caller keeps
    starts: DataFrame  # _part, tree, _first, _n
    ways: DataFrame  # _part, tree, _n, level, at, path, root
    arity: int


def forest(df: DataFrame, by: list[str], arity: int = 2, per_part: int = 20_000, fan: int = 256) -> Forest:
    """The forest over ``df`` (tree, leaf, ``by``): leaves of a tree in the order of ``by``, then of the leaf."""
    rows = durable(df)  # hashed once, then sampled, counted and dealt
    cut = ranged(rows, "tree", *by, "leaf", parts=max(1, math.ceil(rows.count() / per_part)))
    here = cut.groupBy("tree", "_part").agg(F.count("*").alias("_here"))
    tree = Window.partitionBy("tree")  # a row for each range that a tree touches
    starts = durable(here.select("_part", "tree", (F.sum("_here").over(tree.orderBy("_part")) - F.col("_here")).alias("_first"), F.sum("_here").over(tree).alias("_n")))

    def fold(leaves: pa.Table, begin: pa.Table) -> pa.Table:
        out = [
            (begin.column("_part")[0].as_py(), t, x.n, level, at, value, level == len(widths(x.n, arity)) - 1)
            for t, (x, _) in _fragments(leaves, begin, arity).items() for level, nodes in x.nodes.items() for at, value in nodes.items()
        ]
        return _table(out, _NODE)

    folds = cut.select("_part", "_row", "tree", "leaf").groupBy("_part").cogroup(starts.groupBy("_part")).applyInArrow(fold, _NODE)
    nodes = durable(folds)
    return Forest(cut, starts, _ways(nodes, arity, fan), arity)


def _ways(nodes: DataFrame, arity: int, fan: int) -> DataFrame:
    """``nodes`` with ``path`` (siblings up to the root) and ``root``: rounds of the reduction up, then joins down."""
    shape = "_to long, tree string, _n long, level int, at long, to_level int, to_at long, path string, value string, is_root boolean"

    def merge(table: pa.Table) -> pa.Table:
        trees: dict[str, list[tuple]] = defaultdict(list)
        for r in table.to_pylist():
            trees[r["tree"]].append((r["_n"], r["level"], r["at"], r["value"], r["_part"] // fan))
        out = []
        for t, mine in trees.items():
            fragment = Fragment(mine[0][0], arity)
            for _, level, at, value, _ in mine:
                fragment.add(level, at, value)
            fragment.resolve()
            top = len(widths(fragment.n, arity)) - 1
            for n, level, at, _, to in mine:
                to_level, to_at, path = fragment.climb(level, at)
                out.append((to, t, n, level, at, to_level, to_at, path, fragment.nodes[to_level][to_at], to_level == top))
        return _table(out, shape)

    rounds, front = [], nodes.where(~F.col("is_root"))
    parts = nodes.agg(F.max("_part")).first()[0]
    while parts:
        up = durable(front.groupBy((F.col("_part") / fan).cast("long").alias("_g")).applyInArrow(merge, shape))
        rounds.append(up)
        front = up.where(~F.col("is_root")).select(F.col("_to").alias("_part"), "tree", "_n", F.col("to_level").alias("level"), F.col("to_at").alias("at"), "value", "is_root").distinct()
        parts //= fan
    out = nodes.select("_part", "tree", "_n", "level", "at", F.col("level").alias("_l"), F.col("at").alias("_a"), F.lit("").alias("path"), F.col("value").alias("root"))
    for up in rounds:
        step = up.select(*(F.col(a).alias(b) for a, b in (("tree", "tree"), ("level", "_l"), ("at", "_a"), ("to_level", "_tl"), ("to_at", "_ta"), ("path", "_p"), ("value", "_v"))))
        out = out.join(step, ["tree", "_l", "_a"], "left").select(
            "_part", "tree", "_n", "level", "at", F.coalesce("_tl", "_l").alias("_l"), F.coalesce("_ta", "_a").alias("_a"),
            F.concat("path", F.coalesce("_p", F.lit(""))).alias("path"), F.coalesce("_v", "root").alias("root"),
        )
    return durable(out.drop("_l", "_a"))


def _table(rows: list[tuple], shape: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(x.strip().split() for x in shape.split(",")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def manifest(docs: DataFrame, claim: Column | None = None, arity: int = 2, per_part: int = 20_000, fan: int = 256) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified: one row for each of ``docs`` (its columns: ``FIELDS``).

    ``proof`` holds the siblings of the row's way to the root, level by level, left to right.  ``claim`` is the leaf that is
    held against the manifest, as a row read again later would give it (default: the leaf itself); ``folded_root`` is what
    the claim and the proof give, and ``verified`` says whether that is the root.
    """
    own = leaf([F.col(c) for c in FIELDS])
    kind = dict(docs.dtypes)["doc_id"]
    # null first, then bytewise, as Spark orders strings
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select("doc_id", tree.alias("tree"), own.alias("leaf"), (own if claim is None else claim).alias("claim"))
    low = forest(rows, ["doc_id"], arity, per_part, fan)
    high = forest(low.ways.select("tree", F.col("root").alias("leaf")).distinct().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf"), ["name"], arity, per_part, fan)

    top_shape = "name string, _place long, _trees long, _over string, _root string"

    def over(leaves: pa.Table, ways: pa.Table) -> pa.Table:
        """Each tree's name, and its place, siblings and root in the upper tree."""
        return _table([(name, place, n, path, root) for name, _, place, n, _, path, root in _proofs(leaves, ways, arity, "name")], top_shape)

    tops = high.leaves.select("_part", "_row", "tree", "leaf", "name").groupBy("_part").cogroup(_begun(high).groupBy("_part")).applyInArrow(over, top_shape)
    ways = _begun(low).join(tops.withColumnRenamed("name", "tree"), "tree")

    shape = "leaf string, subroot string, root string, proof string, folded_root string, verified boolean"

    def prove(leaves: pa.Table, ways: pa.Table) -> pa.Table:
        top = {t: x for t, *x in zip(*(ways.column(c).to_pylist() for c in ("tree", "_place", "_trees", "_over", "_root")), strict=True)}
        claims = leaves.column("claim").to_pylist()
        out = []
        for i, t, at, n, mine, path, subroot in _proofs(leaves, ways, arity, "_i"):
            place, trees, beyond, root = top[t]
            back = folded(folded(claims[i], at, n, path, arity), place, trees, beyond, arity)
            out.append((i, mine, subroot, root, path + beyond, back, back == root))
        got = _table(out, f"_i long, {shape}")
        return pa.table([leaves.column("doc_id").take(got.column("_i")), *got.columns[1:]], names=["doc_id", *got.column_names[1:]])

    return low.leaves.groupBy("_part").cogroup(ways.groupBy("_part")).applyInArrow(prove, f"doc_id {kind}, {shape}")


def _begun(x: Forest) -> DataFrame:
    return x.ways.join(x.starts.select("_part", "tree", "_first"), ["_part", "tree"])


def _proofs(leaves: pa.Table, ways: pa.Table, arity: int, key: str):
    """key, tree, index, leaves of the tree, leaf, siblings up to the tree's root, that root: for each leaf of a range."""
    begun = ways.select(["tree", "_first", "_n"]).group_by(["tree", "_first", "_n"]).aggregate([])
    fragments = _fragments(leaves, begun, arity)
    above = {(t, level, at): (path, root) for t, level, at, path, root in zip(*(ways.column(c).to_pylist() for c in ("tree", "level", "at", "path", "root")), strict=True)}
    first_row: dict[str, int] = {}
    keys = range(leaves.num_rows) if key == "_i" else leaves.column(key).to_pylist()
    for k, t, row, value in sorted(zip(keys, *(leaves.column(c).to_pylist() for c in ("tree", "_row", "leaf")), strict=True), key=lambda x: x[2]):
        fragment, first = fragments[t]
        at = first + row - first_row.setdefault(t, row)
        level, to, path = fragment.climb(0, at)
        rest, root = above[t, level, to]
        yield k, t, at, fragment.n, value, path + rest, root
