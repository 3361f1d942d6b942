"""Centroid clustering against plain integer arithmetic and its SQL twin."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tests import oracle
from txrisk.llm import centroids
from txrisk.llm.centroids import Settings

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, cluster int, planes string, distance string"


def _plain(rows, settings=Settings()):
    """(id, cluster, distance) by the definition, with Python's integers."""
    kept = [
        (i, v, [math.floor(settings.scale * int(x) if abs(x) >= 2**52 else settings.scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{settings.seed}:{'' if i is None else i}".encode()).hexdigest()
    means = [w for _, _, w in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: settings.clusters]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(w, m, strict=True)) for m in means] for _, _, w in kept]
        return [(min(range(len(means)), key=lambda c: (d[c], c)), min(d)) for d in apart]

    for _ in range(settings.rounds):
        found = assign()
        for c in range(len(means)):
            own = [w for (_, _, w), (k, _) in zip(kept, found, strict=True) if k == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    total = sum(d for _, d in found)
    most = 2**63 - 1
    fits = lambda x: x if x <= most else None
    out = []
    for (i, _, _), (c, d) in zip(kept, found, strict=True):
        own = sum(e for k, e in found if k == c)
        out.append((i, c, fits(d), fits(own), fits(total), digests[c]))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x", "y") for i, v in rows], SCHEMA).repartition(4)


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def _vectors(n, seed, scale=1.0):
    rng = random.Random(seed)
    return [(7 * i - 40, [rng.gauss(0, 1) * scale for _ in range(64)]) for i in range(n)]


def test_clusters_by_definition(spark):
    rows = _vectors(150, 1)
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (6, [0.0] * 64), (7, [-1.0 / 64] * 64), (8, [1e-300, -1e-300] * 32)]
    got = centroids.cluster(_frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert _sorted(got.collect()) == _sorted(_plain(rows))


def test_unusable_vectors_are_left_out(spark):
    rows = _vectors(20, 2)
    odd = [
        (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63),
        (905, [float("nan")] + [0.5] * 63), (906, [float("inf")] + [0.5] * 63), (907, [float("-inf")] + [0.5] * 63),
    ]
    got = centroids.cluster(_frame(spark, rows + odd))
    assert _sorted(got.collect()) == _sorted(_plain(rows))


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = _vectors(3, 3)
    assert _sorted(centroids.cluster(_frame(spark, rows)).collect()) == _sorted(_plain(rows))
    nothing = centroids.cluster(_frame(spark, rows).limit(0))
    assert nothing.count() == 0 and "cluster_inertia" in nothing.columns


@pytest.mark.parametrize("scale", [1e5, 1e12, 1e30])
def test_wide_components(spark, scale):
    """More planes than a 64-bit sum can hold; distances beyond a long are null."""
    rows = _vectors(40, 4, scale) + _vectors(5, 5)
    assert _sorted(centroids.cluster(_frame(spark, rows)).collect()) == _sorted(_plain(rows))


def test_seeds_tie_by_components(spark):
    rows = [(1, v) for _, v in _vectors(30, 6)]
    assert _sorted(centroids.cluster(_frame(spark, rows)).collect()) == _sorted(_plain(rows))


def test_dots_of_planes():
    rng = random.Random(7)
    for planes in (1, 2, 9, 28, 29, 70):
        values = [[rng.randint(-(2 ** (planes - 1)), 2 ** (planes - 1) - 1) for _ in range(64)] for _ in range(6)]
        packed = centroids.pack(values, planes)
        want = [[sum(a * b for a, b in zip(u, v, strict=True)) for v in values] for u in values]
        assert centroids.dots(packed, packed).tolist() == want
        assert centroids.norms(packed).tolist() == [want[i][i] for i in range(6)]


def test_other_settings(spark):
    rows = _vectors(60, 8)
    settings = Settings(clusters=5, rounds=1, scale=16, seed=9)
    assert _sorted(centroids.cluster(_frame(spark, rows), settings).collect()) == _sorted(_plain(rows, settings))


def test_twin(spark):
    con = oracle.connect(SF)
    got = centroids.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = con.execute(centroids.twin())
    assert [d[0] for d in want.description] == got.columns
    assert _sorted(got.collect()) == _sorted(want.fetchall())
    assert np.all(np.array([r.distance for r in got.collect()]) >= 0)
