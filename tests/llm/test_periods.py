"""Lyndon arrays and runs against their definitions, then the edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from foliolink.llm import periods, queries


def plain_lyndon(s):
    return [max(k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[i + j : i + k] for j in range(1, k))) for i in range(len(s))]


def plain_runs(s, least):
    """Every period on its own; a stretch counts with its smallest."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            if i > a and i - a + q >= max(least, 2 * q) and not any(all(s[j] == s[j + p] for j in range(a, i + q - p)) for p in range(1, q)):
                found[a, q] = (a, i - a + q, q)
            i += 1
    return [found[k] for k in sorted(found)]


def sequences(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        k = rng.choice([1, 2, 3, 20])
        s = [rng.randrange(k) for _ in range(rng.randrange(60))]
        if s and rng.random() < 0.5:
            a, p = rng.randrange(len(s)), rng.randrange(1, len(s) + 1)
            s = s[:a] + [s[a + j % min(p, len(s) - a)] for j in range(len(s) - a + rng.randrange(20))]
        out.append(s)
    return out


def flat(seqs):
    return np.array([x for s in seqs for x in s], np.int64), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(300):
        seqs = [[rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(14))] for _ in range(rng.randrange(1, 6))]
        symbols, bounds = flat(seqs)
        if len(symbols):
            assert periods.lyndon_lengths(symbols, bounds).tolist() == [x for s in seqs for x in plain_lyndon(s)]


def test_special_sequences():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a  # Fibonacci words have the most runs
    thue = [bin(k).count("1") % 2 for k in range(256)]
    for s in (b, thue, [0] * 300, [0, 1] * 150, list(range(200)), list(range(40)) * 3):
        symbols, bounds = flat([s])
        assert [tuple(r) for r in periods.runs_of(symbols, bounds, 2).tolist()] == plain_runs(s, 2)


@pytest.mark.parametrize("least", [2, 3, 5, 12, 13])
def test_runs(least, monkeypatch):
    """Also over several slices, and through the stretches that are left out."""
    rng = random.Random(least)
    for slice_ in (periods.SLICE, 30):
        monkeypatch.setattr(periods, "SLICE", slice_)
        for _ in range(120):
            seqs = sequences(rng)
            counts, owner, runs = periods.runs_in_texts([" ".join(map(str, s)).encode() for s in seqs], least)
            assert counts.tolist() == [len(s) for s in seqs]
            got = [(int(k), *map(int, r)) for k, r in zip(owner, runs)]
            assert got == [(k, *r) for k, s in enumerate(seqs) for r in plain_runs(s, least)]


def test_what_is_left_out_holds_no_run():
    rng = random.Random(9)
    prose = [rng.randrange(300) for _ in range(5000)]
    prose[1000:1000] = list(range(500, 540)) * 3
    symbols, bounds = flat([prose, [1] * 11, [2] * 12])
    start, size = periods.suspects(symbols, bounds, 12)
    covered = {k for a, n in zip(start.tolist(), size.tolist()) for k in range(a, a + n)}
    assert set(range(1000, 1120)) <= covered and set(range(bounds[2], bounds[3])) <= covered and len(covered) < 400


def test_frames(spark):
    """Nulls, blank and long texts, repeated rows, clashing names, an empty table."""
    loop = "a b c d " * 5
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t ", 7), (4, "x " + loop + "y", 7), (4, "x " + loop + "y", 7), (5, "z z " * 12, 7), (6, "w " * 100_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(periods.find_runs(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 4, 5, 6]
    assert [[tuple(x) for x in r.runs] for r in got] == [[], [], [], [(1, 20, 4)], [(1, 20, 4)], [(0, 12, 1)], [(0, 100_000, 1)]]
    assert [r.collapsed for r in got] == ["", "", "", "x a b c d y", "x a b c d y", "z z", "w"]
    assert [r.n_words for r in got] == [0, 0, 0, 22, 22, 12, 100_000]
    assert periods.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, least=1)


def test_query_by_definition(spark, sf):
    def digest(t):
        return hashlib.sha256(t.encode()).hexdigest()

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert set(got) == set(texts)
    periodic = 0
    for k, text in texts.items():
        words, h = text.encode().split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:  # the definition takes cubic time
            continue
        runs = plain_runs(words, 12)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == digest(b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
        periodic += bool(runs)
    assert periodic
