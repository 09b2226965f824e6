"""Joins, neighbours and packing against brute force on small fixtures."""

import random
import re

import numpy as np
import pytest

from tidesort.llm import graph, ivfpq, ngram_join, packing, rtree


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(rows, rule):
    """component of each row: least id over links (rows of one id count as linked)."""
    sets = [(k, shingles(t, rule.width)) for k, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and rule.per * len(a & b) >= rule.least * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(sets)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(60)
    rows = []
    hub = text(120)
    for _ in range(40):  # near copies of one text, many just below or above the limit
        own = list(hub)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append(" ".join(own))
    chain = text(100)
    for _ in range(15):  # each is near its neighbour only
        chain = chain[3:] + text(3)
        rows.append(" ".join(chain))
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 33, 50):
        own = text(n)
        rows += [" ".join(own), " ".join(own).upper(), " ".join(own[:-1] + ["zz"])]
    rows += [" ".join(text(20) + passage + text(rng.randrange(80))) for _ in range(30)]
    rows += [" ".join(hub)] * 25 + ["", None, "  \n", "same"] * 2 + [" ".join(["echo"] * 50)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, "one more text under an id that is taken twice"), (None, "same"), (None, "nobody else says this at all")]


@pytest.mark.parametrize(("width", "least", "page", "weight"), [(4, 85, 4096, 10**6), (5, 80, 8, 10**6), (4, 85, 50, 800)])
def test_join_equals_brute_force(spark, monkeypatch, width, least, page, weight):
    monkeypatch.setattr(ngram_join, "PAGE", page)
    monkeypatch.setattr(ngram_join, "WEIGHT", weight)
    rule = ngram_join.Rule(width, least)
    rows = corpus(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in ngram_join.join_documents(df, rule).collect()), key=str)
    assert got == groups(rows, rule)


@pytest.mark.parametrize(("near", "least"), [(1, 85), (6, 85), (9, 80)])
def test_tree_gives_the_links_of_a_group_and_no_more_than_it_needs(near, least):
    rng = np.random.default_rng(near)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = []
    for _ in range(300):
        own = base.copy()
        own[rng.permutation(120)[: rng.integers(0, 2 * near)]] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    rule, nodes = ngram_join.Rule(4, least), np.arange(300) * 7
    group = ngram_join._Group(rule, nodes, np.concatenate(sets), np.array([len(x) for x in sets]), nodes.copy())
    a, b = group.links(7 * 5)
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = lambda x, y: 100 * (k := len(np.intersect1d(sets[x], sets[y]))) >= least * (len(sets[x]) + len(sets[y]) - k)
    for x in range(300):
        for y in range(x):
            if linked(x, y):
                parent[find(x)] = find(y)
    classes = len({find(x) for x in range(300)})
    assert 0 < len(a) == 300 - classes and all(linked(x // 7, y // 7) for x, y in zip(a, b, strict=True))


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    points = rng.poisson(1.5, (700, 40)).astype(np.int32)
    points[::3] = np.maximum(points[0] + rng.integers(-1, 2, (234, 40)), 0)
    sizes = points.sum(axis=1)
    tree = rtree.CountTree(points, sizes, 80, 100)
    for i in range(0, 700, 9):
        found = {int(tree.order[j]) for j in tree.near(points[i], int(sizes[i]), -1)}
        bound = np.minimum(points, points[i]).sum(axis=1)
        assert found == set(np.flatnonzero((180 * bound >= 80 * (sizes + sizes[i]))).tolist())
    assert len(tree.levels) == 3


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join_documents(df).count() == 0


def test_any_block_damage_within_the_bound_leaves_a_common_cell():
    rng = np.random.default_rng(0)
    for least in (80, 85):
        rule = ngram_join.Rule(4, least)
        s = ngram_join.Shingles(rule)
        for n in (1, 2, 5, 6, 7, 13, 20, 50, 147, 300, 1000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                cut = rng.integers(0, (len(a) * (100 - least)) // 100 + 1)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= least * (len(a) + len(b) - both):
                    assert len(np.intersect1d(s.cells(a), s.cells(b)))


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", 5)
    edges = [(1000, 1000 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[201] == got[200] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 20)).astype(np.float32)
    x[100:400] = x[100]  # one vector holds a fifth of all rows
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    bad = [None, [0.0] * 20, [float("nan")] * 20, [1.0] * 19 + [None], [float("inf")] * 20, [1.0, 2.0], []]
    rows += [(5000 + 50 * i, v, None) for i, v in enumerate(bad)] + [(None, [1.0] * 20, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(4)
    got = {}
    for r in ivfpq.self_search(df, every=50, part_values=64 * 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(axis=1))
    hit = total = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        score = (d * d[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -9
        want = np.lexsort((np.arange(len(d)), -score))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & set(want.tolist()))
        total += 5
        if 100 <= q < 400:
            assert [f[1] for f in found] == want.tolist()
    assert hit >= 0.9 * total
    few = ivfpq.self_search(df.where("vec_id in (0, 1, 2)"), every=50).collect()
    assert len(few) == 2
    assert ivfpq.self_search(df.where("vec_id >= 5000"), every=50).count() == 0


def test_neighbours_of_huge_components_and_repeated_ids(spark):
    big, small = 1e308, 1e-300
    rows = [(0, [big, big]), (1, [big, 0.0]), (2, [small, small]), (3, [0.0, small])] + [(7, [1.0, 1.0])] * 40 + [(50, [1.0, 0.5])] * 40
    got = ivfpq.self_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=3).collect()
    found = {q: sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in got if r.query_id == q) for q in (0, 50)}
    assert found[0] == [(1, 2, 1.0), (2, 7, 1.0), (3, 7, 1.0)]
    assert {v for _, v, _ in found[50]} <= {0, 2, 7}


def recall_of(df, vectors, **options):
    """Share of the true neighbours of every fiftieth vector that self_search finds; and the index."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = ivfpq.rows_of(df, "vec_id", "embedding").where("id % 50 = 0")
    index = ivfpq.train(ivfpq.rows_of(df, "vec_id", "embedding"), queries=queries, **options)
    hit = total = 0
    found = {}
    for r in ivfpq.search(ivfpq.rows_of(df, "vec_id", "embedding"), queries, index).collect():
        found.setdefault(r.query_id, []).append(r.score)
    for i in range(0, len(x), 50):
        score = x @ x[i]
        score[i] = -np.inf
        hit += sum(s >= np.sort(score)[-5] - 1e-9 for s in found[i])
        total += 5
    return hit / total, index


def test_recall_where_the_table_is_denser_than_the_sample(spark):
    """Rows gather in few tight places and the index learns from a tenth: lists hold many more codes than in the sample."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20, 16))[rng.integers(20, size=8000)] + 0.02 * rng.normal(size=(8000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    assert recall_of(df, v, sample_rows=800)[0] > 0.9


def test_recall_of_queries_that_lie_otherwise_than_the_rows(spark):
    """Every fiftieth vector is far from the places where the others gather: its neighbours are in many lists."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 24))[rng.integers(60, size=6000)] + 0.1 * rng.normal(size=(6000, 24))
    v[::50] = rng.normal(size=(120, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    found, index = recall_of(df, v)
    assert found > 0.9 and index.sizes.sum() == 6000


def test_index_prunes_where_vectors_gather(spark):
    """Lists and codes that are scored are few, as measured, and the true neighbours are found."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, 32)) * 2).repeat(100, axis=0) + rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    index = ivfpq.train(ivfpq.rows_of(df, "vec_id", "embedding"))
    assert len(index.coarse) == 77 and index.probes < 39 and index.near < 60
    norm = np.sqrt((x * x).sum(axis=1))
    hit = 0
    got = ivfpq.self_search(df, every=50).collect()
    for q in range(0, 6000, 50):
        score = x @ x[q] / (norm * norm[q])
        score[q] = -9
        hit += len(set(np.argsort(-score)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 600 and hit >= 0.9 * 600


@pytest.mark.parametrize("seed", range(4))
def test_packing_fills_and_downsizes(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(1, 4097)]) for _ in range(500)]
    bins, offsets, lengths = packing.pack(sizes)
    held = {}
    for b, o, n in zip(bins, offsets, sizes, strict=True):
        held.setdefault(b, []).append((o, n))
    for b, parts in held.items():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
        used = sum(n for _, n in parts)
        assert lengths[b] == min(c for c in packing.LENGTHS if c >= used)
    assert sum(sizes) / sum(lengths) > 0.9
    assert packing.pack([]) == ([], [], [])


@pytest.mark.parametrize("seed", range(6))
def test_plans_equal_a_plain_best_fit_and_cost_no_more_than_one_length(seed):
    rng = random.Random(seed)
    lengths, most = (60, 100, 250), (30, 60, 250)[seed % 3]
    sizes = [rng.randrange(1, most + 1) for _ in range(150)]

    def plain(opens):
        bins, place, rest = [], {}, sum(sizes)
        for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
            fits = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= sizes[i]]
            if not fits:
                bins.append([opens(sizes[i], rest), 0])
                fits = [(0, len(bins) - 1)]
            b = min(fits)[1] if len({f for f, _ in fits}) == len(fits) else max(b for f, b in fits if f == min(fits)[0])
            bins[b][1] += sizes[i]
            place[i] = b
            rest -= sizes[i]
        return sum(packing.work(min(c for c in lengths if c >= u)) for _, u in bins)

    cheapest = lambda size, rest: min((c for c in lengths if c >= size), key=lambda c: (packing.work(c) / min(c, rest), c))
    cost = sum(map(packing.work, packing.pack(sizes, lengths)[2]))
    assert cost <= plain(cheapest) * 1.02
    for one in lengths:
        if one >= most:
            assert cost <= sum(map(packing.work, packing.pack(sizes, (one,))[2]))


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins, _, lengths = packing.pack([400, 300, 200, 110, 90], lengths=(512,), cost=float)
    assert bins[0] == bins[3] and bins[1] == bins[2] and lengths == [512, 512, 512] and bins[4] == 2


def test_documents_are_packed_whole(spark):
    rows = [(1, "w " * 9000), (2, "a b c"), (2, "a b c"), (None, "n n"), (3, None), (4, " \n"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as bin_id")
    got = packing.pack_documents(df, shard_rows=2).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r["size"]) for r in got) == sorted(
        [("1", 0, 0, 4096), ("1", 1, 4096, 4096), ("1", 2, 8192, 808), ("2", 0, 0, 3), ("2", 0, 0, 3), ("None", 0, 0, 2)]
    )
    assert packing.pack_documents(df.limit(0)).count() == 0
    big = spark.createDataFrame([(2**53 + 1, "a b", 5000), (None, "c", None), (2**53 + 3, "d", 7)], "doc_id long, text string, n long").coalesce(1)
    assert {r.doc_id for r in packing.pack_documents(big).collect()} == {2**53 + 1, 2**53 + 3, None}
    assert sorted((r.doc_id, r.start, r["size"]) for r in packing.pack_documents(big, size="n").collect()) == [(2**53 + 1, 0, 4096), (2**53 + 1, 4096, 904), (2**53 + 3, 0, 7)]
