import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowatlas.llm import clustering


def brute(rows, clusters=16, rounds=3):
    """The same clustering by plain loops over Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1])
    centroids = [v for _, v in sorted(kept, key=name)[:clusters]]
    assign = lambda: [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        mine = assign()
        for n in range(len(centroids)):
            group = [v for (_, v), (_, m) in zip(kept, mine) if m == n]
            if group:
                centroids[n] = [sum(x) // len(group) for x in zip(*group)]
    mine, out = assign(), []
    for (i, _), (d, n) in zip(kept, mine):
        sha = hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
        out.append((i, n, d, sum(e for e, m in mine if m == n), sum(e for e, _ in mine), sha))
    return out


def check(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double")
    found = [tuple(r) for r in clustering.cluster(table, **options).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=order) == sorted(brute(rows, **options), key=order)
    return found


def vectors(n, seed, spread=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, spread) for _ in range(64)] for _ in range(n)]


def test_same_as_brute_force(spark):
    check(spark, list(enumerate(vectors(300, 1, 0.2))))


def test_odd_rows_ties_and_copies(spark):
    rows = list(enumerate(vectors(40, 2)))
    nan, inf = [float("nan")] * 64, [0.0] * 63 + [float("-inf")]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [None] * 64), (905, nan), (906, inf)]
    rows += [(None, [0.5] * 64), (None, [0.25] * 64), (7, [0.5] * 64), (7, [0.5] * 64)] + [(50 + k, [0.125] * 64) for k in range(60)]
    found = check(spark, rows)
    assert len(found) == len(rows) - 7


def test_few_vectors_and_empty_table(spark):
    check(spark, [(3, [1.0] * 64), (4, [-1.0] * 64)])
    assert check(spark, []) == []
    assert check(spark, [(1, [0.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 1e6 for x in v]) for i, v in enumerate(vectors(30, 3))]
    check(spark, rows, clusters=5)
    with pytest.raises(Exception, match="(?i)overflow|too large|out of bounds|not fit|too big"):
        check(spark, [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [1.0] * 64)], clusters=1)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 30, 2**20, 2**24, 2**40]))
def test_search_is_exact_with_ties(seed, spread):
    r = np.random.default_rng(seed)
    a, b = r.integers(-spread, spread, (20, 64), endpoint=True), r.integers(-spread, spread, (9, 64), endpoint=True)
    b[4], a[3] = b[2], (b[2] + b[5]) // 2
    if spread > clustering.SMALL:
        a, b = a.astype(object), b.astype(object)
    number, distance = clustering.nearest(a, b)
    gaps = a.astype(object)[:, None, :] - b.astype(object)[None, :, :]
    exact = (gaps * gaps).sum(axis=2)
    assert list(distance) == list(exact.min(axis=1)) and list(number) == [list(e).index(min(e)) for e in exact]


def test_transform_orders_by_sign_changes_and_keeps_distances():
    eye = np.eye(64, dtype=np.int64)
    functions = clustering.transform(eye).T
    assert [int((np.diff(f) != 0).sum()) for f in functions] == list(range(64))
    assert ((clustering.transform(eye * 3)[0] - clustering.transform(eye * 3)[1]) ** 2).sum() == 64 * 18
