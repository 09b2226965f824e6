"""N-gram Jaccard join: exact links between shingle sets, found with count-vector R-trees.

Shingles (``width`` words) are hashed into groups, and a set becomes the vector of its group counts.  For two sets the
summed coordinate minima bound the overlap from above, so the summed differences bound the symmetric difference from
below.  That bound is used twice:

1. *Cells* spread the points over the cluster.  The groups are dealt into K blocks of coordinates.  Sets that link differ
   in at most ``D = (1 - t) / (1 + t) (|A| + |B|)`` shingles, hence in at most D blocks; with K > D some block agrees
   entirely.  A set therefore visits one cell for each of its blocks, keyed by the hash of what the block holds, in the
   size band of the larger partner.  No linked pair misses a common cell.  The cells of one leader (their least member)
   hold much the same members and are searched as one group, so a pair that meets in many cells is looked at once.
   Groups whose leader follows no other leader are searched first; the others only where their members are still apart then.
2. *R-trees* (:mod:`tidesort.llm.rtree`) index the count vectors of a group.  Each member is searched in the tree, its
   leader first; a node is left out when its corners rule a link out or when all below it is linked with the member
   already; surviving points are verified on the whole sets.  Only links that join two classes leave the task, so a group
   of S near copies gives at most S - 1 rows, and most of its pairs are never looked at.

A group of more than ``PAGE`` members (or ``WEIGHT`` shingles) is dealt into pages by hash, each searched as above together
with the leader.  What the pages leave apart is searched across pages: members outside the largest class of the group
visit the other pages.  No link is lost, and no task holds more than a page.

Hashes are 64 bits.  Blocks are counted so that a set fills more blocks than can differ; by chance of hashing a set fails
this with a probability of about 1e-8 (``bands`` below), and two different sets get one node with about N^2 / 2^65.

Defined results: a null or blank text has no shingles and is alone; fewer words than ``width`` make one shingle; repeated rows
and copies share their component; a null key never becomes a component's name unless all its rows have none; other
columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesort.llm.graph import bounded_batches, components, written
from tidesort.llm.rtree import CountTree

GROUPS = 256
PAGE = 4096
WEIGHT = 4_000_000
CACHE = 200_000
#: Ids up to this many are broadcast (8 to 16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_ODD = np.array([(crc32(f"{i}".encode()) << 32 | crc32(f"odd {i}".encode())) | 1 for i in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Rule:
    """Sets of ``width``-word shingles link when ``per * |A and B| >= least * |A or B|``."""

    width: int = 4
    least: int = 85
    per: int = 100
    growth: float = 1.5

    def edge(self, n: int) -> int:
        """How many blocks can differ for a set of ``n`` shingles and a partner that is no larger."""
        return (self.per - self.least) * 2 * n // (self.per + self.least)

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(band, K) of the bands in which a partner at least as large can lie, own band first."""
        out, most = [], n * self.per // self.least
        band, top = 0, 1
        while True:
            if top >= n:
                r = self.edge(top)
                out.append((band, r + 1 + max(6, 64 // (1 + r))))
            if top >= most:
                return out
            band, top = band + 1, max(top + 1, int(top * self.growth))


class Shingles:
    """Whole texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, rule: Rule):
        self.rule, self.words = rule, {}

    def _word(self, w: bytes) -> int:
        self.words[w] = h = xxhash.xxh3_64_intdigest(w)
        return h

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        width = self.rule.width
        for text in texts:
            tokens = text.encode().lower().split()
            if len(self.words) > CACHE:
                self.words.clear()
            get, make = self.words.get, self._word
            w = np.fromiter((h if (h := get(t)) is not None else make(t) for t in tokens), np.uint64, len(tokens))
            if not len(w):
                yield w
                continue
            span = min(width, len(w))
            total = np.full(len(w) - span + 1, np.uint64(span), np.uint64)
            for k in range(span):
                total = total * np.uint64(0x9E3779B97F4A7C15) + mix(w[k : len(w) - span + 1 + k] + _ODD[k])
            yield np.unique(mix(total))

    def node(self, own: np.ndarray) -> int:
        """One number for a set."""
        if not len(own):
            return 0
        total = mix(own ^ _ODD[40]).sum(keepdims=True) + np.array([len(own)], np.uint64) * _ODD[41]
        return int(mix(total).astype(np.int64)[0])

    def cells(self, own: np.ndarray) -> np.ndarray:
        """Keys of the blocks that hold something: hash of (band, block, counts of the block's groups)."""
        out = []
        for band, k in self.rule.bands(len(own)):
            block = ((own >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # in order, as the set is sorted
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            counts = np.add.reduceat(mix(own ^ _ODD[42]), first)
            out.append(mix(counts ^ mix(block[first] * _ODD[43] + np.array([band], np.uint64) * _ODD[44])))
        return np.concatenate(out).astype(np.int64)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("key"), body.alias("text"), F.xxhash64(body).alias("h"))


def _nodes(rows: DataFrame, rule: Rule) -> DataFrame:
    """(key, h, node, n): the number and the size of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingles(rule)
        for batch in batches:
            nodes, sizes = [], []
            for own in s.sets(batch.column(1).to_pylist()):
                nodes.append(s.node(own))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], ["key", "h", "node", "n"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, h long, node long, n long")


def _stars(rows: DataFrame, rule: Rule) -> DataFrame:
    """(leader, node), distinct: the other members of each cell of several nodes; a cell's leader is its least node.

    A task visits cells once for each different set, so copies don't pile up, and reads a cell's rows in order.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Shingles(rule), set()
        for batch in batches:
            cells, nodes = [], []
            for own in s.sets(batch.column(0).to_pylist()):
                if len(own) and (node := s.node(own)) not in seen:
                    if len(seen) > CACHE:
                        seen.clear()
                    seen.add(node)
                    cells.append(c := s.cells(own))
                    nodes.append(np.full(len(c), node, np.int64))
                if len(cells) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(nodes))], ["cell", "node"])
                    cells, nodes = [], []
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(nodes))], ["cell", "node"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = leader = last = None  # of the row before
        for batch in batches:
            c, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(c):
                continue
            fresh = np.r_[cell is None or c[0] != cell, c[1:] != c[:-1]]
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(c)), -1))
            head = np.where(at >= 0, v[np.maximum(at, 0)], leader if leader is not None else 0)
            new = np.r_[last is None or fresh[0] or v[0] != last, v[1:] != v[:-1]] | fresh
            keep = new & (v != head)
            cell, leader, last = c[-1], head[-1], v[-1]
            if keep.any():
                pairs = np.unique(np.stack([head[keep], v[keep]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["leader", "node"])

    visits = rows.select("text").mapInArrow(visit, "cell long, node long")
    return visits.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(lead, "leader long, node long").distinct()


def _sets(rows: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(node, own): the shingle sets of the nodes of ``wanted`` (node, key, h: a row that has the set)."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rep = wanted.select(F.col("key").alias("rep_key"), F.col("h").alias("rep_h"))
    picked = rows.join(F.broadcast(rep) if few else rep, (rows["h"] == F.col("rep_h")) & rows["key"].eqNullSafe(F.col("rep_key"))).select("h", "text")
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Shingles(rule), set()
        for batch in batches:
            fresh = []
            for i, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    fresh.append(i)
                    if len(seen) > CACHE:
                        seen.clear()
                    seen.add(h)
            for k in range(0, len(fresh), 512):
                sets = list(s.sets(batch.column(1).take(pa.array(fresh[k : k + 512])).to_pylist()))
                edge = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([s.node(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(edge), flat, type=kind)], ["node", "own"])

    return picked.mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


class _Group:
    """The members of one group (or page) in a tree, with their whole sets."""

    def __init__(self, rule: Rule, nodes: np.ndarray, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.rule, self.alias = rule, {}
        self.tree = CountTree(points_of(flat, sizes), sizes, rule.least, rule.per)
        ends = np.cumsum(sizes)
        self.nodes, self.labels = nodes[self.tree.order], labels[self.tree.order]
        self.sets = [flat[e - n : e] for e, n in zip(ends[self.tree.order], self.tree.sizes, strict=True)]
        self.tree.label(self.labels)

    def found(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the members ``at`` link with the set ``own``."""
        out = []
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            values = np.concatenate([self.sets[j] for j in part])
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            shared = np.add.reduceat((own[place] == values).astype(np.int64), np.cumsum([0, *self.tree.sizes[part][:-1]]))
            out.append(part[self.rule.per * shared >= self.rule.least * (len(own) + self.tree.sizes[part] - shared)])
        return np.concatenate(out) if out else at

    def label(self, x: int) -> int:
        while x in self.alias:
            x = self.alias[x]
        return x

    def merge(self, label: int, at: np.ndarray) -> np.ndarray:
        """Joins the classes of the members ``at`` to ``label``; the first member of each class that was another."""
        other, first = np.unique(self.labels[at], return_index=True)
        for x in other:
            self.alias[int(x)] = label
        self.labels[np.isin(self.labels, other)] = label
        self.tree.label(self.labels)
        return at[first]

    def links(self, leader: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that join the classes of the group's members; the leader is searched first."""
        a, b = [], []
        head = int(np.flatnonzero(self.nodes == leader)[0])
        for k in range(-1, len(self.nodes)):
            i = head if k < 0 else k
            at = self.tree.near(self.tree.points[i], int(self.tree.sizes[i]), int(self.labels[i]))
            at = at[at > k]  # the others have looked at this one
            if len(at) and len(at := self.found(self.sets[i], at)):
                at = self.merge(int(self.labels[i]), at)
                a.append(np.full(len(at), self.nodes[i]))
                b.append(self.nodes[at])
        none = np.zeros(0, np.int64)
        return np.concatenate(a or [none]), np.concatenate(b or [none])


def points_of(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Group counts of sets that stand one after another."""
    at = np.repeat(np.arange(len(sizes)), sizes) * GROUPS + (flat & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _read(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, flat values, sizes, comp) of rows."""
    get = lambda c: np.concatenate([p.column(c).to_numpy() for p in parts])
    flat = np.concatenate([p.column("own").flatten().to_numpy() for p in parts]).view(np.uint64)
    return get("node"), flat, np.concatenate([p.column("own").value_lengths().to_numpy() for p in parts]).astype(np.int64), get("comp")


def _tree_links(members: DataFrame, rule: Rule, across: bool = False) -> DataFrame:
    """(a, b): links that join classes, from the trees of all groups.

    ``members``: leader, page, visit, home, big, node, comp, own.  Rows with ``visit`` 0 live on the page and are searched among
    each other; ``across`` pages, visitors (``visit`` 1, from page ``home``) are searched in the page's tree instead, and of
    two pages that could visit each other the later one is visited.  Members of the group's largest class (``big``) never travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, group, big = None, [], None, None
        out_a, out_b, waiting = [], [], 0

        def give(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal waiting
            out_a.append(a)
            out_b.append(b)
            waiting += len(a)

        def emit() -> pa.RecordBatch:
            nonlocal waiting
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
            out_a.clear()
            out_b.clear()
            waiting = 0
            return batch

        def finish() -> None:
            if not across and sum(p.num_rows for p in held) > 1:
                give(*_Group(rule, *_read(held)).links(here[0]))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("leader", "page", "visit")]
            edge = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])])
            for e, at in enumerate(edge):
                part = batch.slice(at, (edge[e + 1] if e + 1 < len(edge) else batch.num_rows) - at)
                if (now := (int(keys[0][at]), int(keys[1][at]))) != here:
                    finish()
                    here, held, group = now, [], None
                if not keys[2][at]:
                    held.append(part)
                    continue
                if group is None and held:
                    group = _Group(rule, *_read(held))
                    big = np.concatenate([p.column("big").to_numpy(zero_copy_only=False) for p in held])[group.tree.order]
                if group is not None:
                    give(*_visited(group, big, here[1], part))
            if waiting >= 8192:
                yield emit()
        finish()
        if waiting:
            yield emit()

    dealt = members.repartition("leader", "page").sortWithinPartitions("leader", "page", "visit")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _visited(group: _Group, big: np.ndarray, page: int, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    nodes, flat, sizes, comps = _read([part])
    points, ends, home = points_of(flat, sizes), np.cumsum(sizes), part.column("home").to_numpy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, node in enumerate(nodes):
        label = group.label(int(comps[i]))
        own = flat[ends[i] - sizes[i] : ends[i]]
        at = group.tree.near(points[i], int(sizes[i]), label)
        at = at[big[at] | (home[i] < page)]
        if len(at) and len(at := group.found(own, at)):
            at = group.merge(label, at)
            a.append(np.full(len(at), node))
            b.append(group.nodes[at])
    return np.concatenate(a), np.concatenate(b)


def _paged(stars: DataFrame, groups: DataFrame) -> DataFrame:
    """(leader, pages, first, page, node): the members of each group by page, and its leader on every page.

    Groups of several pages have thousands of members each; they are joined to the stars alone, and broadcast up to a checked
    number.
    """
    large = groups.where("pages > 1").select("leader", "pages")
    few = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    page = F.pmod(F.xxhash64("node"), F.coalesce("pages", F.lit(1))).cast("int").alias("page")
    dealt = stars.join(few, "leader", "left").select("leader", page, "node")
    leaders = groups.select("leader", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), F.col("leader").alias("node"))
    return dealt.union(leaders).join(groups, "leader").select("leader", "pages", "first", "page", "node")


def join_documents(df: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component): one row for each row of ``df``; component is the least key that links reach."""
    bounded_batches(df.sparkSession)
    rows = _texts(df, key, text)
    docs = written(_nodes(rows, rule), "nodes")
    least = F.min(F.struct("key", "h"))
    nodes = docs.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), least["key"].alias("rep"), least["h"].alias("h"), F.min("n").alias("n"))
    stars = written(_stars(rows, rule), "stars")

    groups = stars.groupBy("leader").agg(F.count("*").alias("size")).join(nodes.select(F.col("node").alias("leader"), "n"), "leader")
    pages = F.greatest(F.ceil((F.col("size") + 1) / PAGE), F.ceil((F.col("size") + 1) * F.col("n") / WEIGHT)).cast("int")
    first = stars.select("leader").join(stars.select(F.col("node").alias("leader")).distinct(), "leader", "left_anti").distinct().withColumn("first", F.lit(True))
    groups = written(groups.select("leader", pages.alias("pages")).join(first, "leader", "left"), "groups")
    members = written(_paged(stars, groups), "members")
    plain = [F.lit(0).alias("visit"), F.lit(0).alias("home"), F.lit(False).alias("big")]
    columns = ["leader", "page", "visit", "home", "big", "node", "comp"]

    def search(chosen: DataFrame, across: bool = False) -> DataFrame:
        wanted = chosen.select("node").distinct().join(nodes, "node").select("node", F.col("rep").alias("key"), "h")
        return written(_tree_links(chosen.join(_sets(rows, wanted, rule), "node").select(*columns, "own"), rule, across), "links")

    # First the groups whose leader follows no other; after them nearly all other groups hold a single class.
    links = search(members.where("first").select("leader", "page", *plain, "node", F.col("node").alias("comp")))
    comps = components(links)
    later = members.where("first is null").join(comps, "node", "left").select("leader", "page", "node", F.coalesce("comp", "node").alias("comp"))
    apart = later.groupBy("leader").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("leader")
    later = written(later.join(apart, "leader").select("leader", "page", *plain, "node", "comp"), "later")
    if not later.isEmpty():
        links = links.union(search(later))
        comps = components(links)

    if not groups.where("pages > 1").isEmpty():
        found = members.where("pages > 1 and node <> leader").join(comps, "node", "left").select("leader", "page", "pages", "node", F.coalesce("comp", "node").alias("comp"))
        found = written(found, "classes")
        sizes = found.groupBy("leader", "comp").agg(F.count("*").alias("size"))
        apart = sizes.groupBy("leader").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
        found = found.join(apart, "leader").withColumn("big", F.col("comp") == F.col("largest"))
        stay = found.select("leader", "page", F.lit(0).alias("visit"), F.col("page").alias("home"), "big", "node", "comp")
        travel = found.where("not big").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).where("other <> page")
        travel = travel.select("leader", F.col("other").alias("page"), F.lit(1).alias("visit"), F.col("page").alias("home"), "big", "node", "comp")
        comps = components(links.union(search(stay.union(travel), across=True)))

    own_comp = nodes.select("node", "key").join(comps, "node", "left").select("node", "key", F.coalesce("comp", "node").alias("comp"))
    least_key = own_comp.groupBy("comp").agg(F.min("key").alias("component"))
    named = own_comp.join(least_key, "comp").select("node", "component")
    out = docs.select("key", "node", "n").join(named, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
