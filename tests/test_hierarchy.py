"""Density hierarchies against a plain version: Prim, a dendrogram walked from its root, and choices by recursion."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from larkspar.operators import hierarchy

SCHEMA = "group long, key long, v array<double>"


def vectors(seed, n, groups=1):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        g = int(r.integers(0, groups))
        centre = np.random.default_rng(100 * g + int(r.integers(0, 4))).normal(size=6)
        out.append((g, int(7 * i % 1009), (centre + r.normal(size=6) * r.choice([0.05, 0.3, 2])).tolist()))
    return [*out, (out[0][0], 2000, out[0][2]), (out[0][0], 2001, out[0][2]), (out[1][0], 2002, out[1][2])]


def plain(rows, m, selection):
    """rows of one group: {key: (cluster, probability)}, and the tree's edges; clusters numbered by their smallest keys."""
    rows = sorted(rows, key=lambda r: r[1])
    x = np.array([v for _, _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(x @ x.T, 12)))
    n = len(x)
    core = np.array([np.sort(np.delete(d[i], i))[min(m, n - 1) - 1] if n > 1 else 0 for i in range(n)])
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges, label = [], list(range(n))
    for w, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if label[i] != label[j]:
            edges.append((w, i, j))
            label = [label[i] if t == label[j] else t for t in label]
    members, tops, nodes = {i: [i] for i in range(n)}, {i: None for i in range(n)}, {}
    where = list(range(n))
    for k, (w, i, j) in enumerate(edges):
        a, b = where[i], where[j]
        nodes[n + k] = (w, a, b, members[a] + members[b])
        members[n + k] = nodes[n + k][3]
        for t in members[n + k]:
            where[t] = n + k
    inverse = lambda w: 1 / max(w, 1e-9)
    clusters = {}  # head: [parent, birth, leaving {point: lambda}, children]

    def walk(node, head):
        w, a, b, _ = nodes[node]
        big = [c for c in (a, b) if len(members[c]) >= m]
        if len(big) == 2:
            for c in big:
                clusters[c] = [head, inverse(w), {}, []]
                clusters[head][3].append(c)
                if c in nodes:
                    stack.append((c, c))
            return
        for c in (a, b):
            if c in big:
                stack.append((c, head))
            else:
                clusters[head][2].update({p: inverse(w) for p in members[c]})

    root = n + len(edges) - 1
    stack = []
    if n >= m and edges:
        clusters[root] = [None, 0.0, {}, []]
        stack = [(root, root)]
        while stack:
            walk(*stack.pop())
    stability = {c: round(sum(v - b for v in leave.values()) + sum((clusters[k][1] - b) * len(members[k]) for k in kids), 6) for c, (_, b, leave, kids) in clusters.items()}
    chosen = set()

    def value(c):
        below = round(sum(value(k) for k in clusters[c][3]), 6)
        if c != root and (not clusters[c][3] if selection == "leaf" else stability[c] >= below):
            chosen.add(c)
        return max(stability[c], below)

    if clusters:
        value(root)

    def top(c):
        way = []
        while c is not None:
            way.append(c)
            c = clusters[c][0]
        return next((c for c in reversed(way) if c in chosen), None)

    found, most = {}, {c: max([*leave.values(), *(clusters[k][1] for k in kids)], default=0) for c, (_, _, leave, kids) in clusters.items()}
    for c, (_, _, leave, _) in clusters.items():
        for p, lam in leave.items():
            t = top(c)
            found[p] = (t, 0.0 if t is None else min(1.0, lam / most[t]))
    first = sorted((min(rows[p][1] for p, (t, _) in found.items() if t == c), c) for c in {t for t, _ in found.values() if t is not None})
    number = {c: i for i, (_, c) in enumerate(first)}
    labels = {rows[p][1]: (number.get(found.get(p, (None, 0))[0], -1), found.get(p, (None, 0.0))[1]) for p in range(n)}
    return labels, [(w, rows[i][1], rows[j][1]) for w, i, j in edges]


def score(labels, edges):
    size, inside, apart, longest = Counter(c for c, _ in labels.values()), defaultdict(float), {}, max(w for w, *_ in edges)
    for w, i, j in edges:
        a, b = labels[i][0], labels[j][0]
        if a == -1 or b == -1:
            continue
        if a == b:
            inside[a] = max(inside[a], w)
        else:
            for c in (a, b):
                apart[c] = min(apart.get(c, w), w)
    total = 0
    for c, n in size.items():
        if c != -1:
            s = apart.get(c, 2 * longest)
            total += n * (s - inside[c]) / max(s, inside[c]) / len(labels)
    return round(total, 9)


@pytest.fixture(params=[(1024, 100_000), (16, 12)], ids=["whole", "in parts"])
def parts(request, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", request.param[0])
    monkeypatch.setattr(hierarchy, "FEW", request.param[1])
    return request.param


def test_sweep_matches_the_plain_version(spark, parts):
    n = 120 if parts[0] > 100 else 60
    rows = vectors(1, n)
    df = spark.createDataFrame(rows, SCHEMA).select("key", "v").repartition(3)
    got = defaultdict(dict)
    for r in hierarchy.sweep(df, [3, 8, 70]).collect():
        got[r.min_cluster_size][r.key] = (r.cluster_id, round(r.probability, 9))
    for m in (3, 8, 70):
        want, _ = plain(rows, m, "eom")
        assert got[m] == {k: (c, round(p, 9)) for k, (c, p) in want.items()}
    assert max(c for c, _ in got[3].values()) >= 2


def test_subdivision_matches_the_plain_version(spark, parts):
    rows = vectors(2, 150 if parts[0] > 100 else 70, groups=3) + [(7, 3000, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (7, 3001, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0])]
    grid = [5, 10]
    got = {r.key: tuple(r)[2:] for r in hierarchy.subdivided(spark.createDataFrame(rows, "cluster long, key long, v array<double>"), grid).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own, trials = [r for r in rows if r[0] == g], []
        for k, m in enumerate(grid):
            labels, edges = plain(own, m, "leaf")
            if 2 * m <= len(own) and max(c for c, _ in labels.values()) >= 1:
                trials.append((score(labels, edges), -k, m, labels))
        for _, key, _ in own:
            if not trials:
                want[key] = (None, str(g), str(g))
            else:
                *_, m, labels = max(trials, key=lambda t: t[:2])
                c = labels[key][0]
                want[key] = (m, str(g) if c == -1 else f"{g}.{c}", None if c == -1 else f"{g}.{c}")
    assert got == want
    assert any("." in f for _, f, _ in want.values())


def test_few_and_no_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA).select("key", "v")
    assert hierarchy.sweep(nothing, [2]).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0])], "key long, v array<double>")
    assert [tuple(r) for r in hierarchy.sweep(few, [2]).collect()] == [(1, 2, -1, 0.0)]
    equal = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(i, [0.0, 1.0]) for i in range(10, 15)], "key long, v array<double>")
    assert {(r.key, r.cluster_id, r.probability) for r in hierarchy.sweep(equal, [3]).collect()} == {*((i, 0, 1.0) for i in range(6)), *((i, 1, 1.0) for i in range(10, 15))}


def test_pointers_of_any_length(spark, monkeypatch):
    r = random.Random(4)
    names = r.sample(range(1000), 200)
    pairs = [(a, b if r.random() < 0.97 else None) for a, b in zip(names, [*names[1:], None], strict=True)]
    pointers = spark.createDataFrame(pairs, "id long, next long")
    few = sorted(map(tuple, hierarchy.last_of(pointers).collect()))
    monkeypatch.setattr(hierarchy, "FEW", 3)
    assert sorted(map(tuple, hierarchy.last_of(pointers).collect())) == few
