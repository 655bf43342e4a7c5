"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. A candidate's inner product with any anchor of a cluster is at
most its own length times the anchor's times the cosine of its angle to the cluster's centre less
the cluster's radius. For each cluster the candidates are sorted by that bound once; every anchor
of the cluster walks the list until the bound proves that nothing better can follow.

Lists are kept in slices of one cell of directions, so that memory stays bounded: an anchor walks
its own cell's slices first, and what it has by then keeps most other slices from being read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, store

#: Anchors from which the centres are learned, centres, candidates in a slice, anchors in a block, and candidates scored at a time; all at most.
SAMPLE, CENTRES, SLICE, BLOCK, STEP = 2048, 32, 1 << 14, 512, 1024
#: Part of a product of lengths that covers the rounding of bounds.
SLACK = 1e-6
FOUND = "anchor_id long, target long, found_id long, score long"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, short ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(axis=1))


def _angles(vectors: np.ndarray, lengths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each vector to each centre; 0 for a vector without length, whose products are 0 anyway."""
    cosine = vectors.astype(float) @ centres.T / np.where(lengths > 0, lengths, 1.0)[:, None]
    return np.where(lengths[:, None] > 0, np.arccos(np.clip(cosine, -1.0, 1.0)), 0.0)


def centres_of(sample: np.ndarray) -> np.ndarray:
    """At most ``CENTRES`` directions, about half the root of the sample's size, by spherical k-means."""
    lengths = _lengths(sample)
    units = sample[lengths > 0].astype(float) / lengths[lengths > 0, None]
    if not len(units):
        return np.ones((1, sample.shape[1])) / math.sqrt(max(1, sample.shape[1]))
    k = min(CENTRES, max(1, math.ceil(math.sqrt(len(units)) / 2)))
    centres = units[np.arange(k) * len(units) // k]
    for _ in range(10):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        size = np.sqrt((sums**2).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.where(size > 1e-9, size, 1.0)[:, None], centres)
    return centres


def walk(
    candidates: tuple[np.ndarray, np.ndarray, np.ndarray], anchors: tuple[np.ndarray, np.ndarray, np.ndarray], centre: np.ndarray,
    owner: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, same: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target the best ``k`` candidates with scores from ``low`` to ``high``: target, place of the candidate, score.

    ``candidates`` and ``anchors`` are ids, labels and vectors; target t belongs to anchor
    ``owner[t]`` and wants candidates of its label (not itself) if ``same``, else of others.
    Candidates below ``floor`` may be left out. Ties go to the smaller id.
    """
    ids, labels, vectors = candidates
    order = np.argsort(ids, kind="stable")
    ids, labels, vectors = ids[order], labels[order], vectors[order]  # the place tells ties apart
    own_id, own_label, own_vector = anchors
    long_c, long_a = _lengths(vectors), _lengths(own_vector)
    bits = max(1, int(len(ids)).bit_length())
    largest = float(long_c.max() * long_a.max()) + 1
    exact = np.float64 if largest < 2**52 else object  # whole numbers either way
    vectors, own_vector = vectors.astype(exact), own_vector.astype(exact)
    key = np.int64 if largest * 2**bits < 2**62 else object
    least = -(1 << 62) if key is np.int64 else -(1 << 200)

    radius = _angles(own_vector.astype(float), long_a, centre[None]).max()
    bound = long_c * np.cos(np.maximum(_angles(vectors.astype(float), long_c, centre[None])[:, 0] - radius, 0.0)) + SLACK * long_c
    listed = np.argsort(-bound, kind="stable")
    bound = bound[listed]

    best = np.full((len(owner), k), least, key)
    need = np.maximum(low, floor)
    active = np.arange(len(owner))
    at = 0
    while at < len(listed):
        active = active[bound[at] * long_a[owner[active]] + 1 >= need[active]]
        if not len(active):
            break
        chunk = np.sort(listed[at : at + STEP])
        at += STEP
        rows, which = np.unique(owner[active], return_inverse=True)
        scores = (own_vector[rows] @ vectors[chunk].T).astype(key)
        fits = own_label[rows][:, None] == labels[chunk][None]
        fits = fits & (own_id[rows][:, None] != ids[chunk][None]) if same else ~fits
        score, fits = scores[which], fits[which]
        fits = fits & (score >= low[active][:, None]) & (score <= high[active][:, None])
        keys = np.where(fits, score * (1 << bits) + (len(ids) - 1 - chunk)[None], least)
        joined = np.concatenate([best[active], keys], axis=1)
        joined = np.partition(joined, joined.shape[1] - k, axis=1)[:, -k:]
        best[active] = joined
        worst = joined.min(axis=1)
        full = worst > least
        need[active[full]] = np.maximum(need[active[full]], (worst[full] >> bits).astype(need.dtype))
    target, column = np.nonzero(best > least)
    found = best[target, column]
    return target, order[(len(ids) - 1 - (found & ((1 << bits) - 1))).astype(np.int64)], found >> bits


def _search(placed: DataFrame, anchors: DataFrame, centres: np.ndarray, k: int, same: bool, home: bool) -> DataFrame:
    """Best candidates of each target in each slice, as ``FOUND``; ``home``: in the slices of the anchor's own cell, else in all others that may hold one.

    ``placed`` has ``id, label, vector, length, cell, angle, part``; ``anchors`` the same with
    ``block`` and ``targets`` (``target, low, high, floor``).
    """
    spark = placed.sparkSession
    width = centres.shape[1]
    unlike = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
    apart = spark.createDataFrame([(a, b, float(unlike[a, b])) for a in range(len(centres)) for b in range(len(centres)) if (a == b) == home] or [(-1, -1, 0.0)], "cluster int, cell int, apart double")
    slices = placed.groupBy("cell", "part").agg(F.max("length").alias("longest"), F.min("length").alias("shortest"), F.max("angle").alias("reach"))
    needed = F.array_min(F.transform("targets", lambda t: F.greatest(t["low"], t["floor"])))
    needed = F.when(F.col("length") > 0, needed / F.col("length")).otherwise(F.lit(float("-inf")))
    blocks = anchors.groupBy(F.col("cell").alias("cluster"), "block").agg(F.max("angle").alias("radius"), F.min(needed).alias("needed"), F.min(F.when(F.col("length") > 0, F.col("length"))).alias("least"))
    cosine = F.cos(F.greatest(F.lit(0.0), F.col("apart") - F.col("radius") - F.col("reach") - 1e-6))
    most = F.when(cosine >= 0, F.col("longest") * cosine).otherwise(F.col("shortest") * cosine) + SLACK * F.col("longest")
    meets = F.coalesce(most + 1 / F.col("least") >= F.col("needed"), F.lit(True))
    # At most CENTRES squared rows are broadcast; the pairs carry no vectors.
    pairs = blocks.join(F.broadcast(apart), "cluster").join(slices, "cell").where(meets).select("cluster", "block", "cell", "part")
    keys = ["cluster", "block", "cell", "part"]
    left = placed.select("id", "label", "vector", "cell", "part").join(pairs, ["cell", "part"])
    right = anchors.select(F.col("cell").alias("cluster"), "block", "id", "label", "vector", "targets").join(pairs, ["cluster", "block"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, as both sides come from one table
    shared = spark.sparkContext.broadcast(centres)

    def meet(candidates: pa.Table, members: pa.Table) -> pa.Table:
        if not candidates.num_rows or not members.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "target", "found_id", "score")})
        numbers = lambda column: column.to_numpy()
        ids, own = numbers(candidates["id"]), numbers(members["id"])
        targets = members["targets"].combine_chunks()
        owner = np.repeat(np.arange(len(own)), np.diff(targets.offsets.to_numpy()))
        name, low, high, floor = (targets.flatten().field(c).to_numpy() for c in ("target", "low", "high", "floor"))
        centre = shared.value[members["cluster"][0].as_py()]
        at, place, score = walk(
            (ids, numbers(candidates["label"]), _matrix(candidates["vector"], width)), (own, numbers(members["label"]), _matrix(members["vector"], width)),
            centre, owner, low, high, floor, k, same,
        )
        return pa.table({"anchor_id": own[owner[at]], "target": name[at], "found_id": ids[place], "score": pa.array(score.tolist(), pa.int64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)


def _best(placed: DataFrame, anchors: DataFrame, centres: np.ndarray, k: int, same: bool) -> DataFrame:
    """The ``k`` best of all slices per target, with ``rank``: own cells first, then what can still matter."""
    near = store(_search(placed, anchors, centres, k, same, home=True), "near")
    w = Window.partitionBy("anchor_id", "target").orderBy(F.desc("score"), "found_id")
    last = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k)
    floors = last.groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("_floors"))  # as many as targets
    raised = F.transform("targets", lambda t: t.withField("floor", F.coalesce(F.element_at("_floors", t["target"]), t["floor"])))
    rest = anchors.join(floors, "id", "left").withColumn("targets", raised).drop("_floors")
    far = _search(placed, rest, centres, k, same, home=False)
    found = store(near.unionByName(far).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
    release(near)
    return found


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low_percent: int = 30, high_percent: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of rows ``id long, label long, vector array<bigint>``.

    An anchor's positives are the ``n_positives`` other rows of its label with the highest inner
    product; for each one the negatives are the ``n_negatives`` highest rows of other labels between
    ``low_percent`` and ``high_percent`` of the positive's score. Ties go to the smaller id.

    Rows with a null id, label, vector or component take no part. Of rows with one id the least
    (label, vector) stays, so repeated rows count once. Short vectors are filled up with zeros. A
    positive with a score below zero has no negatives, as no score is between those bounds. Extra
    columns are ignored. A score beyond 64 bits fails the job. Results are exact; only the
    centres are learned from a sample (``SAMPLE`` anchors).
    """
    whole = vectors.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    marked = whole.groupBy("id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "vector")).alias("v")).select("id", "v.label", "v.vector")
    rows = store(marked.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    sample = rows.where("anchor").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    learned = np.zeros((len(sample), width), np.int64)
    for k, row in enumerate(sample):
        learned[k, : len(row.vector)] = row.vector
    centres = centres_of(learned)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<length: double, cell: int, angle: double>")
    def place(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            given = _matrix(part, width)
            lengths = _lengths(given)
            angles = _angles(given, lengths, shared.value)
            cell = angles.argmin(axis=1)
            nearest = angles[np.arange(len(cell)), cell]
            yield pa.StructArray.from_arrays([pa.array(lengths), pa.array(cell.astype(np.int32)), pa.array(nearest)], ["length", "cell", "angle"])

    found = rows.withColumn("_at", place("vector")).select("id", "label", "vector", "anchor", "_at.*")
    placed = store(found, "placed")
    release(rows)
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).alias("parts"), F.ceil(F.count(F.when(F.col("anchor"), 1)) / BLOCK).alias("blocks"))
    counts = placed.sparkSession.createDataFrame(counts.collect(), "cell int, parts long, blocks long")  # CENTRES rows at most
    dealt = placed.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    anchors = dealt.where("anchor").withColumn("block", F.pmod(F.xxhash64(F.col("id") + 1), F.col("blocks")))
    lowest, highest = F.lit(-(2**62)), F.lit(2**62)
    target = lambda name, low, high: F.struct(name.alias("target"), low.alias("low"), high.alias("high"), low.alias("floor"))

    seeking = anchors.withColumn("targets", F.array(target(F.col("id"), lowest, highest)))
    positives = _best(dealt, seeking, centres, n_positives, same=True)
    score = F.col("score")
    window = target(F.col("found_id"), F.expr(f"({low_percent} * score + 99) div 100"), F.expr(f"({high_percent} * score) div 100"))
    per_anchor = positives.where(score >= 0).groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(window).alias("targets"))  # n_positives at most
    negatives = _best(dealt, anchors.join(per_anchor, "id"), centres, n_negatives, same=False)
    known = positives.select("anchor_id", F.col("found_id").alias("target"), F.col("score").alias("positive_score"))
    return negatives.join(known, ["anchor_id", "target"]).select(
        "anchor_id", F.col("target").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
