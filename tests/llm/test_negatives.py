"""Hard negatives against all products, then ties, zeros, ragged rows and bounds."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolink.llm import negatives, queries

SCHEMA = "id long, label long, vector array<long>, score string, part int"


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain(rows, n_positives=5, n_negatives=10):
    out = set()
    for a, label, vector in rows:
        if a % 100:
            continue
        scored = sorted((-product(vector, v), k, other) for k, other, v in rows if k != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:n_negatives]
            out |= {(a, p, r, k, -s, -t) for r, (t, k, _) in enumerate(fit, 1)}
    return out


def run(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = negatives.hard_negatives(table, F.col("id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


def clustered(rng, n, width, labels, spread):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(k, rng.randrange(labels), [int(100 * (c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for k in range(0, 10 * n, 10)]


def test_walk_against_all_products():
    """Each target's best within its window, whatever the step; sure ends come before the list's end on clustered vectors."""
    rng = random.Random(4)
    for step in (1, 7, 1024):
        negatives.STEP, kept = step, negatives.STEP
        try:
            for _ in range(40):
                rows = clustered(rng, rng.randrange(1, 40), 3, 3, rng.choice([0.05, 1.0]))
                rows = [(k, y, v if rng.random() < 0.9 else [0, 0, 0]) for k, y, v in rows]
                ids, labels, vectors = (np.array(x) for x in zip(*rows))
                own = [r for r in rows if r[0] % 30 == 0]
                same = rng.random() < 0.5
                targets = [(a, *sorted(rng.choice([(-(2**62), 2**62), (-500, 700), (0, 20_000)]))) for a in range(len(own)) for _ in range(2)]
                owner, low, high = (np.array(x) for x in zip(*targets))
                k = rng.randrange(1, 6)
                centre = negatives.centres_of(np.array([r[2] for r in own]))[0]
                at, place, score = negatives.walk((ids, labels, vectors), tuple(np.array(x) for x in zip(*own)), centre, owner, low, high, low, k, same)
                got = {(int(t), int(ids[p]), int(s)) for t, p, s in zip(at, place, score)}
                want = set()
                for t, (a, lo, hi) in enumerate(targets):
                    scored = sorted((-product(own[a][2], v), i) for i, y, v in rows if ((y == own[a][1] and i != own[a][0]) if same else y != own[a][1]))
                    want |= {(t, i, -s) for s, i in [x for x in scored if lo <= -x[0] <= hi][:k]}
                assert got == want
        finally:
            negatives.STEP = kept


def test_walk_ends_before_the_list(monkeypatch):
    rng = random.Random(1)
    centre = np.array([1.0, 0.0])
    near = [[1000 + rng.randrange(50), rng.randrange(-50, 50)] for _ in range(200)]
    far = [[rng.randrange(100), 500] for _ in range(5000)]
    vectors = np.array(near + far)
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(np.shape(other)[-1])
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(negatives, "STEP", 100)
    own = np.array([[1000, 3], [900, -4]])
    ids = np.arange(len(vectors))
    at, place, score = negatives.walk(
        (ids, np.ones(len(ids), int), vectors), (np.array([-1, -2]), np.array([1, 1]), own.view(Counted)), centre, np.array([0, 1]), np.array([-(2**62)] * 2), np.array([2**62] * 2), np.array([-(2**62)] * 2), 5, True
    )
    everything = np.sort(vectors @ own.T, axis=0)[::-1][:5]
    assert sorted(score[at == 0].tolist(), reverse=True) == everything[:, 0].tolist() and sorted(score[at == 1].tolist(), reverse=True) == everything[:, 1].tolist()
    assert 0 < sum(scored) <= 500  # of 5200


def test_large_numbers_stay_exact():
    """Products beyond what doubles hold."""
    big = 1 << 29
    vectors = np.array([[big, 1], [big, 2], [big, 3]])
    all_ = np.array([-(2**62)]), np.array([2**62]), np.array([-(2**62)])
    at, place, score = negatives.walk((np.arange(3), np.ones(3, int), vectors), (np.array([9]), np.array([1]), np.array([[big, 1]])), np.array([1.0, 0.0]), np.array([0]), *all_, 3, True)
    assert sorted(int(s) for s in score) == [big * big + k for k in (1, 2, 3)]


@pytest.fixture
def small_parts(monkeypatch):
    for name, size in (("SLICE", 30), ("BLOCK", 2), ("STEP", 8)):
        monkeypatch.setattr(negatives, name, size)


def test_frame_against_all_products(spark, small_parts):
    """Many slices and blocks; ties, zeros, one very common vector, short vectors, negative ids and few positives."""
    rng = random.Random(8)
    rows = clustered(rng, 120, 4, 3, 0.4)
    rows += [(2000 + k, k % 3, [50, 50, 0, 0]) for k in range(60)]
    rows += [(-100, 0, [10, 20, 30, 40]), (-101, 1, [10, 20]), (-200, 9, [5, 5, 5, 5]), (3000, 1, [0, 0, 0, 0]), (3001, 1, [0, 0, 0, 0]), (3002, 2, [])]
    assert run(spark, rows + rows[:5]) == plain(rows)


def test_rows_that_take_no_part_and_empty_tables(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 2]), (100, None, [1, 1]), (200, 1, None), (300, 1, [None, 1]), (None, 1, [1, 1]), (4, 2, [1, 2])]
    assert run(spark, rows) == {(0, 1, 1, 2, 25, 14), (0, 1, 2, 4, 25, 11)}
    assert run(spark, rows[2:3]) == set() and run(spark, []) == set()


def test_query_vectors(spark):
    rows = [(7, [0.5, -0.001], 9), (8, [0.5, 0.0], 3), (9, [float("nan"), 0.0], 3), (10, [float("inf"), 0.0], 3), (11, None, 3), (12, [0.1, None], 3), (13, [0.1], None)]
    made = queries.labelled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, made.collect())) == [(7, 0, [128, -1]), (8, 3, [128, 0])]
