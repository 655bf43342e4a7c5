"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts is one flat array of code points. It is cut into words wherever no piece of the
vocabulary holds the two characters on both sides of the cut, which no merge could ever cross.
Each distinct word's symbols go into one flat array, in which every round takes the best rank of
a neighbouring pair in each word, merges that pair's occurrences from the left and closes the
gaps, until no word has a pair left.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mark that stands for a space, and kinds of pieces in a model file.
SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: A pair without a rank.
NONE = np.int32(2**31 - 1)
#: Bytes of text that are encoded at a time, and characters of distinct words that are remembered.
SLICE, REMEMBERED = 1 << 19, 1 << 20


class Vocabulary:
    """The pieces of a BPE model as arrays: what merges, what a symbol is written as, and what an id reads as.

    Symbols are ids of pieces; characters that only occur inside longer pieces get symbols beyond them.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True, unknown_text: str = " ⁇ "):
        self.size = len(pieces)
        ids = {p: k for k, p in enumerate(pieces) if kinds[k] == NORMAL}
        inner = sorted({c for p in ids for c in p} - set(ids))
        symbols = ids | {c: self.size + k for k, c in enumerate(inner)}
        _, ranks = np.unique([-scores[k] for k in ids.values()], return_inverse=True)
        rank_of = dict(zip(ids, ranks.tolist()))

        splits = [(symbols[p[:k]], symbols[p[k:]], rank_of[p], ids[p]) for p in ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(splits, np.int64).reshape(-1, 4)
        self.width = self.size + len(inner)
        keys = table[:, 0] * self.width + table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32)
        # A symbol is early if it can go on to merge before other occurrences of the pair that made it.
        rank = np.full(self.width, -1, np.int64)
        rank[list(ids.values())] = ranks
        self.early = np.zeros(self.width, bool)
        for part in (table[:, 0], table[:, 1]):
            self.early[part[rank[part] >= table[:, 2]]] = True
        self.early[[k for s, k in symbols.items() if len(s) == 1]] = False  # characters are never made

        joined = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        letters = sorted({c for pair in joined for c in pair})
        self.classes = np.zeros(0x110000, np.int32)  # 0: never inside a longer piece
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_classes = len(letters) + 1
        self.joins = np.zeros(self.n_classes**2, bool)
        for a, b in joined:
            self.joins[self.classes[ord(a)] * self.n_classes + self.classes[ord(b)]] = True

        self.symbols = {c: k for c, k in symbols.items() if len(c) == 1}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(pieces) if kinds[k] == BYTE}
        self.inner = inner
        self.dummy_prefix = dummy_prefix

        shown = [self._shown(p, kind, unknown_text) for p, kind in zip(pieces, kinds)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(s) for s in shown])]).astype(np.int64)
        self.control = np.array(kinds) == CONTROL
        self.spaced = np.array([kind == NORMAL and p.startswith(SPACE_MARK) for p, kind in zip(pieces, kinds)])

    @staticmethod
    def _shown(piece: str, kind: int, unknown_text: str) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: unknown_text.encode()}.get(kind, piece.replace(SPACE_MARK, " ").encode())

    def written(self, symbol: int, char: str) -> list[int]:
        """Ids of a symbol: itself, or the bytes of a character that is no piece."""
        return [symbol] if 0 <= symbol < self.size else [self.bytes[b] for b in char.encode()]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank ``NONE`` where it makes no piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], NONE), np.where(found, self.merged[at], -1)


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file: BPE with byte fallback, texts taken as they are."""
    from sentencepiece import sentencepiece_model_pb2 as form

    model = form.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, way = model.trainer_spec, model.normalizer_spec
    kinds = [p.type for p in model.pieces]
    if spec.model_type != 2 or spec.treat_whitespace_as_suffix or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
        raise ValueError(f"{path}: only BPE with byte fallback, without pieces of the user's own, is supported")
    if way.precompiled_charsmap or way.remove_extra_whitespaces or not way.escape_whitespaces:
        raise ValueError(f"{path}: only models that keep texts as they are are supported")
    return Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], kinds, way.add_dummy_prefix, spec.unk_surface)


def merge_rounds(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and how many each has.

    The library merges one best pair of a word after the other, the leftmost of equals. All
    occurrences go in one round, unless what they make could merge further before the next
    occurrence: then only the word's leftmost one.
    """
    text = "".join(words)
    known = vocabulary.symbols
    symbol = np.fromiter((known.get(c, -1) for c in text), np.int32, len(text))
    place = np.arange(len(text))
    word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    rank, made = _ranks(vocabulary, symbol, word)
    kept_symbol, kept_word, kept_place = [], [], []
    while len(symbol):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(word)))
        done = np.repeat(best == NONE, size)
        if done.any():
            kept_symbol.append(symbol[done])
            kept_word.append(word[done])
            kept_place.append(place[done])
            symbol, word, place, rank, made = (x[~done] for x in (symbol, word, place, rank, made))
            size, best = size[best != NONE], best[best != NONE]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == np.repeat(best, size))
        # Of touching occurrences every second one goes, from the left.
        chain = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))) % 2 == 0]
        if vocabulary.early[made[at]].any():
            lead = np.flatnonzero(np.diff(word[at], prepend=-1))
            lone = np.logical_or.reduceat(vocabulary.early[made[at]], lead)
            many = np.repeat(~lone, np.diff(np.append(lead, len(at))))
            many[lead] = True
            at = at[many]
        symbol[at] = made[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # where they are once the gaps are closed
        symbol, word, place, rank, made = (x[keep] for x in (symbol, word, place, rank, made))
        for touched in (at, at[at > 0] - 1):
            here, there = symbol[touched], symbol[np.minimum(touched + 1, len(symbol) - 1)]
            rank[touched], made[touched] = vocabulary.pairs(here, there)
            rank[touched[(touched + 1 >= len(word)) | (word[np.minimum(touched + 1, len(word) - 1)] != word[touched])]] = NONE
    if not kept_symbol:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64)
    symbol, word, place = map(np.concatenate, (kept_symbol, kept_word, kept_place))
    order = np.argsort(place, kind="stable")
    symbol, word, place = symbol[order], word[order], place[order]
    plain = (symbol >= 0) & (symbol < vocabulary.size)
    if plain.all():
        return symbol, np.bincount(word, minlength=len(words))
    spelled = {k: vocabulary.written(int(symbol[k]), text[place[k]]) for k in np.flatnonzero(~plain)}
    times = np.ones(len(symbol), np.int64)
    times[list(spelled)] = [len(v) for v in spelled.values()]
    out, start = np.repeat(symbol, times), np.cumsum(times) - times
    for k, ids in spelled.items():
        out[start[k] : start[k] + len(ids)] = ids
    return out, np.bincount(word, weights=times, minlength=len(words)).astype(np.int64)


def _ranks(vocabulary: Vocabulary, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of each symbol with its right neighbour in the word."""
    rank, made = np.full(len(symbol), NONE, np.int32), np.full(len(symbol), -1, np.int32)
    if len(symbol) > 1:
        rank[:-1], made[:-1] = vocabulary.pairs(symbol[:-1], symbol[1:])
        rank[:-1][word[1:] != word[:-1]] = NONE
    return rank, made


class _Words(dict):
    """Numbers words; new ones wait in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes lists of texts; remembers the ids of ``REMEMBERED`` characters of distinct words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.words, self.chars = _Words(), 0
        self.flat, self.start, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.told = 0

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        ids, sizes = merge_rounds(self.vocabulary, new)
        self.chars += sum(map(len, new))
        self.flat = _room(self.flat, self.used + len(ids))
        self.start, self.size = (_room(x, self.told + len(new)) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.told : self.told + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.told : self.told + len(new)] = sizes
        self.used, self.told = self.used + len(ids), self.told + len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and how many each text has."""
        if self.chars > REMEMBERED:
            self._forget()
        v = self.vocabulary
        marked = [(SPACE_MARK if v.dummy_prefix and t else "") + t.replace(" ", SPACE_MARK) for t in texts]
        joined = "".join(marked)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        lengths = np.array([len(m) for m in marked])
        kind = v.classes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(joined) + 1, bool)
        cut[1:-1] = ~v.joins[kind[:-1] * v.n_classes + kind[1:]]
        ends = np.cumsum(lengths)
        cut[ends] = True
        at = np.flatnonzero(cut)
        bounds = at.tolist()
        number = np.fromiter(map(self.words.__getitem__, [joined[a:b] for a, b in zip(bounds, bounds[1:])]), np.int64, len(bounds) - 1)
        if self.words.new:
            self._learn()
        size = self.size[number]
        ids = _gather(self.flat, self.start[number], size)
        through = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(through[np.searchsorted(at, ends)], prepend=0)


def _room(array: np.ndarray, needed: int) -> np.ndarray:
    """``array``, at least doubled if ``needed`` is beyond its end."""
    if needed <= len(array):
        return array
    wider = np.empty(max(needed, 2 * len(array)), array.dtype)
    wider[: len(array)] = array
    return wider


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` from ``start``, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes are about ``most`` together."""
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the ids of each text without begin and end marks, as array<int>.

    A null or empty text has none. Any other column stays as it is; a column ``out`` is replaced.
    Repeated rows are encoded each.
    """
    return docs.withColumn(out, encoded(docs.sparkSession, F.col(f"`{text}`"), vocabulary))


def encoded(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for part in parts:
            for low, high in ranges(pc.binary_length(part).to_numpy(), SLICE):
                ids, sizes = encoder.encode(part[low:high].to_pylist())
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))

    return of(F.coalesce(text, F.lit("")))


def _one_each(error: UnicodeError) -> tuple[str, int]:
    """A replacement character for each byte that begins no character."""
    return "�" * (error.end - error.start), error.end


def decode_flat(vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Texts of ``sizes`` ids each: pieces and bytes put together, the space that encoding put first taken off."""
    if len(ids) and not (0 <= ids.min() and ids.max() < vocabulary.size):
        raise ValueError("an id is outside the vocabulary")
    codecs.register_error("one_each", _one_each)
    width = np.diff(vocabulary.shown_at)[ids]
    start = vocabulary.shown_at[ids]
    if vocabulary.dummy_prefix and len(ids):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        real = np.flatnonzero(~vocabulary.control[ids])
        lead = real[np.flatnonzero(np.diff(owner[real], prepend=-1))]
        lead = lead[vocabulary.spaced[ids[lead]]]
        start[lead] += 1
        width[lead] -= 1
    body = _gather(vocabulary.shown, start, width).tobytes()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(vocabulary.control[ids])]))  # bytes on both sides of a mark make no character
    ends = np.concatenate([[0], np.cumsum(width)])[cuts].tolist()
    parts = [body[a:b].decode("utf-8", "one_each") for a, b in zip(ends, ends[1:])]
    first = np.searchsorted(cuts, bounds).tolist()
    return ["".join(parts[a:b]) for a, b in zip(first, first[1:])]


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the text of each row's ids.

    A null row or one without ids is an empty text; null ids within a row are passed over; an
    id outside the vocabulary fails the job. Any other column stays; a column ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            offsets, flat = part.offsets.to_numpy(), part.values.to_numpy()
            sizes = np.diff(offsets)
            for low, high in ranges(sizes, SLICE // 4):
                yield pa.array(decode_flat(shared.value, flat[offsets[low] : offsets[high]], sizes[low:high]), pa.string())

    given = F.coalesce(F.filter(F.col(f"`{ids}`"), lambda k: k.isNotNull()), F.array().cast("array<int>"))
    return docs.withColumn(out, of(given))
