"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, join_spread, release, store
from .components import components

BITS = 64
_BLOCK = 1 << 16


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of one text: bit i is 1 if more than half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        here = max(1, len(part) - width + 1)
        shingles = map(b" ".join, zip(*(part[k : k + here] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, here)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """64-bit fingerprint as a signed long; a null or empty text has fingerprint zero."""

    @F.pandas_udf(T.LongType())
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint_of(t, width, seed) for t in part], np.uint64).view(np.int64))

    return of(text)


#: Fingerprints with one segment value from which on the value is split further.
CROWDED = 1024


def _other_half(seg: Column, fp: Column) -> Column:
    return F.when(seg == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def _byte(half: Column, k: int) -> Column:
    return F.shiftright(half, 8 * k).bitwiseAND(F.lit(0xFF)).cast("int")


def _split_crowded(rows: DataFrame, crowded: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``part, byte``: one row for a usual segment value, four, by the bytes of the other segment, for a crowded one."""
    half = _other_half(F.col("seg"), F.col(column))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).alias("byte")))
    bytewise = F.array(*[F.struct(F.lit(k).alias("part"), _byte(half, k).alias("byte")) for k in range(4)])
    return rows.join(crowded, ["seg", "val"], "left").select(*rows.columns, F.inline(F.when(F.col("crowd").isNull(), whole).otherwise(bytewise)))


def near_pairs(prints: DataFrame, column: str = "fp", distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Pairs of different fingerprints at most ``distance`` (0 to 3) bits apart, each once: ``(a, b)``.

    Two fingerprints that differ in at most 3 bits differ in at most one bit of one of their
    two 32-bit segments. Each fingerprint looks up the radius-1 ball around each segment; as
    two values one bit apart differ by a bit that one of them has set, it is enough that each
    side clears its own set bits. The join verifies the complete distance and leaves out what
    the first segment has found already, so no candidate outlives the join. ``prints`` holds
    each fingerprint once (copies are one row), so a large group of copies is no large bucket.
    A segment value that more than ``crowded`` fingerprints share is split by the bytes of the
    other segment: at most 3 bits differ there, so one of its four bytes is equal, and the
    first equal one finds the pair.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with radius 1 cover distances 0 to 3")
    fp = F.col(column)
    segments = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(fp, 32).alias("val")),
        F.struct(F.lit(1).alias("seg"), fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("val")),
    )
    cut = prints.select(fp.alias("fp"), F.inline(segments))
    table = cut.select("seg", "val", F.col("fp").alias("b"))
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    ball = F.concat(
        F.array(F.lit(0).cast("long")),
        F.filter(bits, lambda bit: F.col("val").bitwiseAND(bit) != 0),
    )
    probes = cut.select("seg", "val", F.col("fp").alias("a"), F.explode(ball).alias("bit")).select(
        "seg", (F.col("val") - F.col("bit")).alias("val"), "a", "bit"
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    apart_high = F.bit_count(F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), 32))
    hit = (
        (F.col("p.seg") == F.col("t.seg"))
        & (F.col("p.val") == F.col("t.val"))
        & (apart <= distance)
        & ((F.col("bit") != 0) | (F.col("a") < F.col("b")))
        & ((F.col("p.seg") == 0) | (apart_high > 1))
    )
    crowd = store(table.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("seg", "val", F.lit(True).alias("crowd")), "crowded")
    if not crowd.isEmpty():
        probes, table = _split_crowded(probes, crowd, "a"), _split_crowded(table, crowd, "b")
        differs = _other_half(F.col("p.seg"), F.col("a").bitwiseXOR(F.col("b")))
        first = F.lit(True)
        for k in range(3):
            first = first & ((F.col("p.part") <= k) | (_byte(differs, k) != 0))
        hit = hit & (F.col("p.part") == F.col("t.part")) & (F.col("p.byte") == F.col("t.byte")) & first
    return probes.alias("p").join(table.alias("t"), hit).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``(id, fp, component_id)``, the id under ``id_col``.

    ``component_id`` is the smallest id that links of at most ``distance`` differing bits
    reach, the document's own included. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows stay; a row with a null id is linked but never names a
    component, and a component of null ids only has a null ``component_id``. Other columns of
    ``docs`` are not read. An empty table gives an empty table.
    """
    marks = store(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width, seed).alias("fp")), "fingerprints")
    prints = marks.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = components(near_pairs(prints.select("fp"), "fp", distance))
    linked = groups.join(prints, groups["node"] == prints["fp"]).select("root", "fp", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    moved = linked.join(lowest, "root").select("fp", "lowest")
    named = store(prints.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"), "n"), "components")
    return join_spread(marks, named.drop("n"), ["fp"], ["id"], named.select("fp", "n")).select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_hashes(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of a text's distinct word shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k : k + count] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, count))


def _set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _set_print(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0].astype(np.int64))


def repeated_shingles(texts: pd.Series, width: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two texts or more have, ascending, and the number of texts that have each.

    All shingles lie in one array, sorted in place; a text has at most one word for every other character.
    """
    held, size = np.empty(sum(len(t or "") // 2 + 1 for t in texts), np.uint64), 0
    for text in texts:
        hashes = shingle_hashes(text, width, seed)
        held[size : size + len(hashes)] = hashes
        size += len(hashes)
    held = held[:size]
    held.sort()
    edges = np.diff(np.concatenate(([0], (held[1:] == held[:-1]).astype(np.int8), [0])))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return held[first], last - first + 1


#: Texts whose shingles are counted side by side; a bound of a task's memory.
SLICE = 2_500


def common_shingles(docs: DataFrame, text_col: str, width: int, seed: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles of all texts, ascending, and their counts; any answer is right, a good one saves work.

    Every text is counted, copies within a batch once. Only shingles that two texts of ``SLICE``
    hold leave their slice, so one that is rare everywhere is never shuffled and one that is in
    many texts is missed only in slices that hold it once.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].drop_duplicates()
            for at in range(0, len(texts), SLICE):
                found, n = repeated_shingles(texts.iloc[at : at + SLICE], width, seed)
                yield pd.DataFrame({"shingle": found.view(np.int64), "n": n})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "shingle long, n long")
    got = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    hashes = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], got["n"].to_numpy(np.int64)[order]


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's members by slot, a power of two of slots, at least 64 and the set's size, as signed longs.

    Each member that just one of two sets has changes one parity, so sketches of one length
    differ in at most as many bits as the sets in members. Halves of a sketch, combined by
    exclusive or, are the sketch of half the length.
    """
    slots = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


#: Words of the sketch that pairs are compared by where they meet, at most: 1,024 bits.
BRIEF = 16


def _folded(sketch: Column, k: Column, size: Column) -> Column:
    """Word ``k`` of a parity sketch folded to ``size`` words."""
    return F.aggregate(F.sequence(k, F.size(sketch), size), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.element_at(sketch, j)))


def _brief(sketch: Column) -> Column:
    """A parity sketch folded to ``BRIEF`` words at most."""
    size = F.least(F.size(sketch), F.lit(BRIEF))
    return F.transform(F.sequence(F.lit(1), size), lambda k: _folded(sketch, k, size))


def _apart(a: Column, b: Column) -> Column:
    """Differing bits of two parity sketches, the longer one folded to the length of the other."""
    size = F.least(F.size(a), F.size(b))
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda n, k: n + F.bit_count(_folded(a, k, size).bitwiseXOR(_folded(b, k, size))))


def _most_apart(n: Column, m: Column, similarity: float) -> Column:
    """Members that just one of two sets of ``n`` and ``m`` has, at most, if they are alike."""
    return F.lit((1 - similarity) / (1 + similarity)) * (n + m) + 1e-6


def _per_key(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.count("*").alias("n"))


#: The bitmap of wanted texts has 16 bits a text, to this many bits at most (16 MB); with more texts more pass it, never fewer.
MOST_BITS = 27


def _bitmap(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Packed bits of the slots that the hashes fall into, and the mask that gives a slot."""
    bits = min(MOST_BITS, max(16, (16 * hashes.count()).bit_length()))
    mask = (1 << bits) - 1
    slot = hashes.select(F.col(column).bitwiseAND(F.lit(mask)).alias("slot")).distinct()
    words = slot.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    filled = np.zeros(1 << (bits - 6), np.int64)
    got = words.toPandas()  # at most 2**bits / 64 rows
    filled[got["word"].to_numpy(int)] = got["bits"].to_numpy(np.int64)
    return filled.astype("<i8").view(np.uint8), mask


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, width: int, seed: int, similarity: float) -> DataFrame:
    """The ``pairs (a, b)`` of set keys whose shingle sets have a Jaccard similarity of ``similarity`` or more, from the texts again.

    Pairs whose parity sketches differ in more bits than such sets can in members go first;
    texts of the others are found by a bitmap where they are read, so no text is shuffled.
    """
    pairs = store(pairs, "candidates")
    sketches = sets.select("key", F.col("n").alias("size"), "sketch")
    of_a = sketches.toDF("a", "size_a", "sketch_a")
    of_b = sketches.toDF("b", "size_b", "sketch_b")
    both = join_spread(pairs, of_a, ["a"], ["b"], _per_key(pairs)).join(of_b, "b")
    most = _most_apart(F.col("size_a"), F.col("size_b"), similarity)
    pairs = store(both.where(_apart(F.col("sketch_a"), F.col("sketch_b")) <= most).select("a", "b"), "likely")
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    bits, mask = _bitmap(store(sets.join(keys, "key", "left_semi").select("text_hash"), "wanted"), "text_hash")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def wanted(hashes: pd.Series) -> pd.Series:
        slot = hashes.to_numpy(np.int64) & mask
        return pd.Series((shared.value[slot >> 3] >> (slot & 7)) & 1 == 1)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies within the task
        for part in parts:
            got = []
            for text_hash, text in zip(part["text_hash"], part["text"]):
                if text_hash not in seen:
                    seen.add(text_hash)
                    got.append(shingle_hashes(text, width, seed))
            yield pd.DataFrame({"key": np.array([_set_key(h) for h in got], np.int64), "shingles": [h.view(np.int64) for h in got]})

    # apart, as each Python function of a task is a worker of its own, and all workers stay
    texts = store(docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where(wanted("text_hash")), "wanted_texts")
    full = store(texts.mapInPandas(read, "key long, shingles array<long>").dropDuplicates(["key"]), "shingles")
    release(texts)
    met = join_spread(pairs, full.toDF("a", "of_a"), ["a"], ["b"], _per_key(pairs)).join(full.toDF("b", "of_b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return met.where(common >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row per document: ``(id, component_id)``; links are Jaccard similarities of ``width``-word shingle sets of ``similarity`` or more.

    No pair is lost and none is linked unverified. Texts with equal sets are one set. First,
    SimHash groups (at most 3 bits a link) are verified against their smallest member, and so
    are the sets that share a shingle of their prefixes against the first of them; that
    links large groups without their pairs. Then every pair in different components that
    shares a prefix shingle is verified. With the shingles in one order, rare ones first, two
    sets of n and m shingles that are alike share one of the first n - ceil(similarity * n) + 1
    and of the first m - ceil(similarity * m) + 1, which a fingerprint can't promise: at 0.8 it
    differs in 10 of 64 bits on average. Ids, null texts and repeated rows as in
    :func:`near_duplicates`; texts without words link only with each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, width, seed))
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        for part in parts:
            keys, prints, sizes, prefixes, sketches = [], [], [], [], []
            for text in part["text"]:
                hashes = shingle_hashes(text, width, seed)
                weight = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    weight = np.where(known[at] == hashes, counts[at], 0)
                n = len(hashes)
                prefix = hashes[np.argsort(weight, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]
                keys.append(_set_key(hashes))
                prints.append(_set_print(hashes))
                sizes.append(n)
                prefixes.append(prefix.view(np.int64))
                sketches.append(parity_sketch(hashes))
            yield part.drop(columns="text").assign(key=keys, fp=prints, n=sizes, prefix=prefixes, sketch=sketches)

    kind = dict(named.dtypes)["id"]
    marks = store(named.mapInPandas(read, f"id {kind}, text_hash long, key long, fp long, n int, prefix array<long>, sketch array<long>"), "shingle_sets")
    sets = store(marks.groupBy("key").agg(F.min("id").alias("first"), F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "sets")

    # only shingles of two different sets go on
    shared_by = marks.select(F.explode("prefix").alias("shingle"), "key").groupBy("shingle").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    met = store(shared_by.where("low < high").select("shingle", "n"), "shared_prefixes")
    places = marks.dropDuplicates(["key"]).select("key", "n", F.posexplode("prefix").alias("pos", "shingle"))
    places = store(join_spread(places, met.select("shingle"), ["shingle"], ["key"], met, "left_semi"), "places")
    heads = places.groupBy("shingle").agg(F.min(F.struct("key", "n", "pos")).alias("head"))
    rows = store(join_spread(places, heads, ["shingle"], ["key"], met), "shared_shingles")

    def possible(n: Column, pos: Column, m: Column, at: Column) -> Column:
        """What the sizes and the places of the first common shingle leave."""
        return F.least(n - pos, m - at) >= F.lit(similarity / (1 + similarity)) * (n + m) - 1e-6

    near_head = rows.where((F.col("key") != F.col("head.key")) & possible(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
    prints = sets.where("n > 0").groupBy("fp").agg(F.min("key").alias("low"))
    balls = components(near_pairs(prints.select("fp")))
    grouped = sets.where("n > 0").join(balls.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("key").alias("low"))
    of_print = grouped.join(lowest, "root").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    links = store(_verified(of_print.unionAll(near_head.select(F.col("head.key"), F.col("key"))).distinct(), sets, docs, text_col, width, seed, similarity), "links")

    roots = components(links)
    placed = rows.join(roots, F.col("key") == F.col("node"), "left").select("shingle", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    briefs = sets.select("key", _brief(F.col("sketch")).alias("sketch"))
    open_rows = store(placed.join(mixed, "shingle", "left_semi").join(briefs, "key").select("shingle", "key", "n", "pos", "root", "sketch"), "open_shingles")
    a = open_rows.toDF("shingle", "a", "n_a", "pos_a", "root_a", "sketch_a")
    b = open_rows.toDF("shingle", "b", "n_b", "pos_b", "root_b", "sketch_b")
    # what follows are conditions of the join itself: pairs whose sizes, places or brief sketches rule them out are no rows
    met = join_spread(a, b, ["shingle"], ["a"], open_rows.groupBy("shingle").agg(F.count("*").alias("n"))).where(
        (F.col("a") < F.col("b"))
        & (F.col("root_a") != F.col("root_b"))
        & possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
        & (_apart(F.col("sketch_a"), F.col("sketch_b")) <= _most_apart(F.col("n_a"), F.col("n_b"), similarity))
    )
    more = _verified(met.select("a", "b").distinct(), sets, docs, text_col, width, seed, similarity)
    groups = components(roots.select("root", "node").unionAll(more))  # the stars stand for the links
    rooted = sets.join(groups, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = store(rooted.join(least, "root").select("key", "component_id"), "components")
    copies = sets.select("key", F.col("copies").alias("n"))
    return join_spread(marks.select("id", "key"), of_set, ["key"], ["id"], copies).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The rows of ``docs`` whose id names its component by ``find``: one document of each group stays.

    Rows that repeat the id of a kept document stay with it; rows with a null id stay, as
    nothing tells which of them to keep. Spark broadcasts the ids that go where their table is small.
    """
    found = find(docs, id_col, text_col, **options)
    mark = fresh(docs, "gone")
    gone = store(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(mark)).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone[mark], "left_anti")
