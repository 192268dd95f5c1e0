"""Operators on vectors against brute force, and their edge cases."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from adjudica.llm import vector_codes, vector_dedup

VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, code string, error string"


def vectors(spark, rows):
    """Vectors with further columns whose names clash with those of results and internals."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], b, *["x"] * 4) for i, v, b in rows], VECTORS)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    good = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    dim = len(good[0][1]) // parts
    whole = [[math.floor(Fraction(x) * 4096) for x in r[1]] for r in good]
    cut = [[w[p * dim : p * dim + dim] for w in whole] for p in range(parts)]
    books = [c[:entries] for c in cut]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for x in cut[p]:
                own[near(x, books[p])].append(x)
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else old for o, old in zip(own, books[p], strict=True)]
    out = []
    for k, (i, _, b) in enumerate(good):
        code = [near(cut[p][k], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(cut[p][k], books[p][c]) for p, c in enumerate(code)), b))
    total = Counter()
    for _, _, e, b in out:
        total[b] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(total[b]) if all(f < 1 << 63 for _, _, f, g in out if g == b) else None, digest) for i, c, e, b in out), key=str)


def clustered(seed, n, dim, spots=9, noise=0.05):
    r = np.random.default_rng(seed)
    at = r.normal(size=(spots, dim))
    return [list(map(float, at[k % spots] + noise * r.normal(size=dim))) for k in range(n)]


@pytest.mark.parametrize("case", ["noise", "clusters", "ties", "few", "wide", "huge", "dirty"])
def test_vector_codes(spark, case):
    r = np.random.default_rng(5)
    rows = {
        "noise": [(i, list(map(float, r.normal(size=16))), i % 3) for i in range(300)],
        "clusters": [(i, v, i % 4) for i, v in enumerate(clustered(1, 700, 32))],
        "ties": [(i, [float(i % 3), 0.0, -1.0, 1.0] * 4, None if i % 2 else 1) for i in range(150)] + [(500 + i, [0.5] * 16, 2) for i in range(200)],
        "few": [(i, list(map(float, r.normal(size=8))), 0) for i in range(5)],
        "wide": [(i, list(map(float, 40 * r.normal(size=64))), i % 2) for i in range(120)],
        "huge": [(i, list(map(float, r.normal(size=8) * (1e30 if i % 5 == 0 else 1e4))), i % 3) for i in range(60)],
        "dirty": [(i, v, 7) for i, v in enumerate(clustered(2, 40, 8))]
        + [(50, None, 1), (51, [1.0, None] * 4, 1), (52, [float("nan")] * 8, 1), (53, [float("inf")] + [0.0] * 7, 1), (54, [1.0] * 16, 1), (55, [], 1), (None, [0.25] * 8, 7), (3, [0.5] * 8, None)],
    }[case]
    got = vector_codes.vector_codes(vectors(spark, rows), chunk=128).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows)


def test_vector_codes_empty_and_odd(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, [1.0] * 7, 0), (2, [2.0] * 8, 0)])).count() == 0


def test_trees_hold_every_point_once_and_prune():
    x = np.floor(4096 * np.array(clustered(3, 2000, 8, spots=16, noise=0.01))).astype(np.int64)
    t = vector_codes.tree(x)
    assert sorted(t["order"]) == list(range(2000))
    assert (t["x"] == x[t["order"]]).all()
    entries = x[:16]
    owned, _, points, _ = vector_codes.walk(t, entries)
    assert (t["end"] - t["start"])[owned].sum() + len(points) == 2000
    assert len(points) < 200, "balls of a cluster are owned whole"


def brute_links(rows, least=0.98):
    """One row a vector by comparing all pairs of a label, with components."""
    usable = [v is not None and b is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, b in rows]
    unit = [np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v))) if ok else None for (_, v, _), ok in zip(rows, usable, strict=True)]
    near = [[] for _ in rows]
    by = {}
    for k, (_, v, b) in enumerate(rows):
        if usable[k]:
            by.setdefault((b, len(v)), []).append(k)
    for group in by.values():
        u = np.array([unit[k] for k in group])
        for i, j in np.argwhere(u @ u.T >= least):
            if i != j:
                near[group[i]].append(group[j])
    out = []
    root = [None] * len(rows)
    for k in range(len(rows)):
        if root[k] is None:
            todo, mine = [k], {k}
            while todo:
                for x in near[todo.pop()]:
                    if x not in mine:
                        mine.add(x)
                        todo.append(x)
            ids = [rows[x][0] for x in mine if rows[x][0] is not None]
            for x in mine:
                root[x] = (min(ids) if ids else None,)
        out.append((rows[k][0], len(near[k]), root[k][0], rows[k][0] == root[k][0]))
    return sorted(out, key=str)


def planted(seed, n, dim, least=0.98, spread=1.0):
    """Vectors with partners at a cosine from ``least`` up, just under it too."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        u = r.normal(size=dim)
        u /= np.linalg.norm(u)
        w = r.normal(size=dim)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = [least + 1e-4, least - 1e-4, least + 0.01, 0.9][k % 4]
        out += [u * r.uniform(0.1, 9), (c * u + math.sqrt(1 - c * c) * w) * spread]
    return [list(map(float, v)) for v in out]


@pytest.mark.parametrize(("dim", "kw"), [(64, {}), (64, {"words": 512}), (32, {"block": 40}), (5, {}), (2, {}), (1, {})])
def test_vector_dedup(spark, dim, kw):
    rows = [(i, v, i % 6 // 2) for i, v in enumerate(planted(dim, 300, dim) if dim > 1 else [[float(x % 7 - 3)] for x in range(60)])]
    got = vector_dedup.vector_dedup(vectors(spark, rows), **kw).collect()
    want = brute_links(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(n for _, n, _, _ in want) > 50


def test_hot_spot_and_copies(spark):
    r = np.random.default_rng(8)
    spot = r.normal(size=64)
    spot /= np.linalg.norm(spot)
    rows = [(i, list(map(float, spot + 0.017 * r.normal(size=64))), 1) for i in range(700)]
    rows += [(1000 + i, list(map(float, spot)), 1) for i in range(400)] + [(2000 + i, v, 1) for i, v in enumerate(planted(3, 100, 64))]
    want = brute_links(rows)
    for kw in ({}, {"block": 64}):
        assert sorted(map(tuple, vector_dedup.vector_dedup(vectors(spark, rows), **kw).collect()), key=str) == want
    assert max(n for _, n, _, _ in want) > 800


def test_recall_at_the_threshold(spark):
    # every pair at 0.9801 of 4,000: the chance of a miss is under one in a million each
    r = np.random.default_rng(4)
    u = r.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = r.normal(size=(4000, 64))
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.9801 * u + math.sqrt(1 - 0.9801**2) * w
    rows = [(2 * i + side, list(map(float, x[i])), 0) for i in range(4000) for side, x in enumerate((u, v))]
    got = vector_dedup.vector_dedup(vectors(spark, rows)).where("n_links > 0").count()
    assert got == 8000


def test_vector_dedup_edges(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 4, 0), (4, [-0.0] * 4, 0), (5, [1.0, None, 0.0, 0.0], 0), (6, [float("nan")] * 4, 0), (7, [float("inf"), 0.0, 0.0, 0.0], 0), (8, one, None), (9, one, None)]
    rows += [(10, one, 0), (11, [2 * x for x in one], 0), (11, [1e300 * x for x in one], 0), (12, one + [0.0], 0), (13, one, 1), (None, one, 0), (14, [-x for x in one], 0), (15, [0.0, -0.0, 0.0, 1e-300], 2), (16, [-0.0, 0.0, 0.0, 5.0], 2)]
    got = sorted(map(tuple, vector_dedup.vector_dedup(vectors(spark, rows)).collect()), key=str)
    assert got == brute_links(rows)
    alone = sorted(map(tuple, vector_dedup.vector_dedup(vectors(spark, [(None, one, 0), (None, one, 0)])).collect()), key=str)
    assert alone == [(None, 1, None, True)] * 2
    assert vector_dedup.vector_dedup(vectors(spark, [])).count() == 0
