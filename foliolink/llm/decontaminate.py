"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, join_spread, store

_TOKEN = re.compile(r"\w+")
#: The bitmap has two to this many bits at most (16 MB): with more than 8 million seeds more windows pass it, never fewer.
MOST_BITS = 27
#: Base of the rolling hash (any odd number of 64 bits).
_BASE = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word (letters, digits, underscores; lower-cased)."""
    words = _TOKEN.findall((text or "").lower())
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` tokens, modulo 2**64."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _BASE + tokens[k : k + n]
    return total


def seeds_of(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows; of fewer tokens than ``width`` the hash of them all."""
    return rolling(tokens, min(width, len(tokens))) if len(tokens) else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(doc start, item start, length)``, longest first, none overlapping.

    Windows of ``min_match`` tokens with equal rolling hashes start the matches, which grow
    as far as the tokens agree. The longest match is marked in both sequences; what marks
    have cut from another match goes back as shorter matches.
    """
    of_doc, of_item = rolling(doc, min_match), rolling(item, min_match)
    near = np.flatnonzero(np.isin(of_doc, of_item))
    order = near[np.argsort(of_doc[near], kind="stable")]
    keys = of_doc[order]
    heap: list[tuple[int, int, int]] = []
    for i, key in enumerate(of_item):
        at = order[np.searchsorted(keys, key, "left") : np.searchsorted(keys, key, "right")]
        if i:
            at = at[(at == 0) | (doc[at - 1] != item[i - 1])]  # only where a maximal match begins
        length = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        step = 0
        while len(live) and i + step < len(item):
            live = live[at[live] + step < len(doc)]
            live = live[doc[at[live] + step] == item[i + step]]
            length[live] += 1
            step += 1
        heap += [(-int(n), i, int(j)) for n, j in zip(length, at) if n >= min_match]
    heapq.heapify(heap)
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    found = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = free_item[i : i - n] & free_doc[j : j - n]
        if free.all():
            free_item[i : i - n] = free_doc[j : j - n] = False
            found.append((j, i, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= min_match:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return found


def _item_seeds(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    schema = f"item_id {benchmark.schema[item_col].dataType.simpleString()}, n_words int, seed long, at array<int>"

    def seeds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for item, text in zip(part["item_id"], part["text"]):
                words = token_hashes(text)
                places: dict[int, list[int]] = {}
                for k, h in enumerate(seeds_of(words, width).view(np.int64).tolist()):
                    places.setdefault(h, []).append(k)
                out += [(item, len(words), h, at) for h, at in places.items()]
            yield pd.DataFrame(out, columns=["item_id", "n_words", "seed", "at"])

    named = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null")
    return named.mapInPandas(seeds, schema)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.8,
    bits: int = 20,
) -> DataFrame:
    """Pairs with a test item of which tiles cover at least ``coverage``: ``(id, item_id, n_words, n_covered, n_tiles)``.

    Windows of ``min_match`` words that a document shares with an item are the seeds. A
    bitmap over the items' seeds (16 bits a seed, ``2**bits`` to ``2**MOST_BITS`` of them)
    lets most windows go where they are read; the others are joined with the seeds by hash.
    Tiles lie within seeds, so a pair whose seeds cover less than ``coverage`` of the item is
    out; the other documents are read again and tiled whole. Tiles needn't be in the item's
    order, so reordered passages count. Items of fewer than ``min_match`` words match texts of
    just these words, in their order. Ids of both tables can be of any type. Null ids and
    texts without a word match nothing; rows that repeat an id are tiled one by one and give
    the best of their results. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    seeds = store(_item_seeds(benchmark, item_col, item_text_col, min_match), "seeds")
    bits = min(MOST_BITS, max(bits, (16 * seeds.count()).bit_length()))
    mask = (1 << bits) - 1
    slots = seeds.select(F.col("seed").bitwiseAND(F.lit(mask)).alias("slot")).distinct()
    words = slots.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    filled = np.zeros(1 << (bits - 6), np.int64)
    got = words.toPandas()  # at most 2**bits / 64 rows
    filled[got["word"].to_numpy(int)] = got["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(filled.astype("<i8").view(np.uint8))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def windows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed = shared.value
        for part in texts:
            out = []
            for text in part:
                hashes = np.unique(seeds_of(token_hashes(text), min_match))
                slot = hashes & np.uint64(mask)
                out.append(hashes[(packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0].view(np.int64))
            yield pd.Series(out)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    hits = store(rows.select("id", F.explode(windows("text")).alias("seed")), "hits")
    starts = F.sort_array(F.array_distinct(F.flatten(F.collect_list("at"))))
    reach = F.transform(
        F.col("starts"),
        lambda p, k: F.when(k + 1 < F.size("starts"), F.least(F.lit(min_match), F.element_at("starts", k + 2) - p)).otherwise(F.lit(min_match)),
    )
    pairs = (
        join_spread(hits, seeds, ["seed"], ["id"], hits.groupBy("seed").agg(F.count("*").alias("n")))
        .groupBy("id", "item_id", "n_words")
        .agg(starts.alias("starts"))
        .where(F.aggregate(reach, F.lit(0), lambda a, x: a + x) >= F.lit(coverage) * F.col("n_words"))
        .select("id", "item_id")
    )
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    wanted = store(
        pairs.join(items, "item_id").groupBy("id").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")), "candidates"
    )
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((rows, "id"), (benchmark, item_col))]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, n_words int, n_covered int, n_tiles int"

    def tiled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, text, listed in zip(part["id"], part["text"], part["items"]):
                doc = token_hashes(text)
                for item in listed:
                    words = token_hashes(item["item_text"])
                    if len(words) < min_match:
                        if np.array_equal(doc, words):
                            out.append((key, item["item_id"], len(words), len(words), 1))
                        continue
                    found = tiles(doc, words, min_match)
                    covered = sum(n for _, _, n in found)
                    if covered >= coverage * len(words):
                        out.append((key, item["item_id"], len(words), covered, len(found)))
            yield pd.DataFrame(out, columns=["id", "item_id", "n_words", "n_covered", "n_tiles"])

    best = rows.join(wanted, "id").mapInPandas(tiled, schema).groupBy("id", "item_id").agg(F.max(F.struct("n_covered", "n_words", "n_tiles")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", "best.n_words", "best.n_covered", "best.n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that contain no test item; rows with a null id stay."""
    mark = fresh(docs, "leak")
    leaks = store(overlaps(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(mark)).distinct(), "leaks")
    return docs.join(leaks, docs[id_col] == leaks[mark], "left_anti")
