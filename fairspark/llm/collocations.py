"""Collocations per language from FM-indexes over word ids, one index per shard of text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairspark.functions.ordering import pinned
from fairspark.llm import ragged
from fairspark.llm.tables import stored
from fairspark.session import scratch_path

#: Words of a shard; its index is what one task holds.
SHARD_WORDS = 1 << 20
SLICE_BYTES = 4 << 20
#: Phrases of all shards that one task sums.
PART_ENTRIES = 2_000_000
LEAST_COUNT = 10
MOST_WORDS = 3
TOP = 2_000
#: A candidate goes if a longer one around it has so many percent of its occurrences.
COVER_PERCENT = 50
#: Score unit: parts per million.
SCALE = 1_000_000
#: Copies of a single word's count, so that phrases around a frequent word meet it in several tasks.
COPIES = 8
#: Shares of a language that are cut to the first ``top`` before they meet.
SHARES = 64
#: Bands of the score per doubling.
BANDS = 16

#: A-Z lower-cased, piece separators as line feeds, blanks as spaces.
_FOLD = ragged.LOWER.copy()
_FOLD[[*b".,;:!?\n\x0b\x0c\r"]] = 10
_FOLD[[*b" \t"]] = 32
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[10], _KIND[32] = 1, 2
_CUTS = (_KIND[:, None] != _KIND[None, :]).ravel()


# Index ---------------------------------------------------------------------------


def sorted_places(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys, none negative or over ``most``, and the place of each; equal keys by place.

    Key and place are sorted as one number where both fit into it, several times faster than sorting places by key.
    """
    bits = len(key).bit_length()
    if int(most).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    packed = np.sort((key.astype(np.int64) << bits) | np.arange(len(key)))
    return packed >> bits, packed & ((1 << bits) - 1)


def depth_sorted(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` by their next ``depth`` symbols at least, ties by position; past the end lies 0."""
    rank, known = ids.astype(np.int64), 1
    while True:
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[: max(len(rank) - known, 0)] = rank[known:]
        kinds = int(rank.max(initial=0)) + 1
        key, order = sorted_places(rank * kinds + behind, kinds**2)
        known *= 2
        if known >= depth:
            return order
        step = np.append(0, np.cumsum(np.diff(key) != 0)) if len(key) else key
        # The text's 0 has to stay the least, which sorting keeps: rank 0 starts with it.
        rank = np.empty_like(key)
        rank[order] = step + 1


def transform(ids: np.ndarray, depth: int) -> np.ndarray:
    """Symbol before each position in depth-sorted order (Burrows-Wheeler transform, depth-limited).

    Sorting to ``depth`` symbols keeps every interval of a phrase of up to ``depth`` words in one piece.
    """
    return ids[depth_sorted(ids, depth) - 1].astype(np.int32)


@dataclass
class Direction:
    """Backward search over one transform."""

    bwt: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        """Place of each row among all by (symbol, row): C[c] + Occ(c, i) for the symbol c of row i."""
        _, order = sorted_places(self.bwt, int(self.bwt.max(initial=0)))
        out = np.empty_like(order)
        out[order] = np.arange(len(order))
        return out

    def extend(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All one-symbol extensions of the intervals: owner, symbol, count, new start, and rows of the interval with a lesser symbol."""
        rows = ragged.gather(start, size)
        symbol = self.bwt[rows].astype(np.int64)
        kinds = int(symbol.max(initial=0)) + 1
        key, at = sorted_places(np.repeat(np.arange(len(start)) * kinds, size) + symbol, len(start) * kinds)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(first, append=len(key))
        owner, symbol = np.divmod(key[first], kinds)
        lesser = first - (np.cumsum(size) - size)[owner]
        # The first row of an interval with a symbol leads to where the extended interval begins.
        return owner, symbol, count, self.places[rows[at[first]]], lesser


@dataclass
class Level:
    """Phrases of one length: words by column, interval starts in both directions, counts."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray

    def only(self, keep: np.ndarray) -> Level:
        return Level(self.words[keep], self.forward[keep], self.backward[keep], self.count[keep])


class BidirectionalIndex:
    """FM-index of a text of word ids and of its reversal, searched in step.

    0 separates pieces of text; the text begins and ends with it. A phrase is an interval in both
    transforms. Extending it to the left narrows the forward interval by backward search, and the reverse
    one by the number of occurrences whose left neighbour is lesser; to the right the other way round.
    """

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.forward, self.backward = Direction(forward), Direction(backward)
        self.symbols = np.bincount(forward) if len(forward) else np.zeros(1, np.int64)

    @cached_property
    def edges(self) -> list[np.ndarray]:
        return [np.append(0, np.cumsum(d.bwt == 0)) for d in (self.forward, self.backward)]

    def words(self) -> Level:
        """All single words, by id."""
        start = np.cumsum(self.symbols) - self.symbols
        return Level(np.arange(1, len(self.symbols))[:, None], start[1:], start[1:], self.symbols[1:])

    def longer(self, level: Level, known: list[np.ndarray]) -> Level:
        """Extensions of ``level`` by a word whose other part, without the word at the far end, is known too.

        ``known[j]`` holds the ascending keys of phrases of j + 1 words, see ``place``. Every second
        length is reached from the left, the others from the right.
        """
        left = level.words.shape[1] % 2 == 1
        own, other = (level.forward, level.backward) if left else (level.backward, level.forward)
        owner, symbol, count, start, lesser = (self.forward if left else self.backward).extend(own, level.count)
        inside = symbol > 0
        owner, symbol, count, start, lesser = owner[inside], symbol[inside], count[inside], start[inside], lesser[inside]
        old = level.words[owner]
        words = np.column_stack([symbol, old]) if left else np.column_stack([old, symbol])
        keep = place(words[:, :-1] if left else words[:, 1:], known) >= 0
        shifted = other[owner] + lesser
        forward, backward = (start, shifted) if left else (shifted, start)
        return Level(words, forward, backward, count).only(keep)

    def neighbours(self, level: Level) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each phrase that have a word of their piece to the left, to the right."""
        out = []
        for edge, start in zip(self.edges, (level.forward, level.backward)):
            out.append(level.count - (edge[start + level.count] - edge[start]))
        return out[0], out[1]


class TextIndex(BidirectionalIndex):
    """The index of a text, each direction of which is built when a length first needs it.

    A transform is two sorts of a million numbers, far less than writing both and reading them in each round.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth = ids, depth
        self.symbols = np.bincount(ids)

    @cached_property
    def forward(self) -> Direction:
        return Direction(transform(self.ids, self.depth))

    @cached_property
    def backward(self) -> Direction:
        return Direction(transform(self.ids[::-1], self.depth))


def place(words: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Index of each phrase among the known ones of its length, -1 where it is none."""
    at = np.zeros(len(words), dtype=np.int64)
    for j in range(words.shape[1]):
        if not len(known[j]):
            return np.full(len(words), -1)
        if j == 0:
            # The key of a single word is its id.
            table = np.full(max(int(known[0][-1]), int(words[:, 0].max(initial=0))) + 1, -1)
            table[known[0]] = np.arange(len(known[0]))
            at = table[words[:, 0]]
            continue
        key = at * (1 << 32) + words[:, j]
        found = np.minimum(np.searchsorted(known[j], key), len(known[j]) - 1)
        at = np.where((at >= 0) & (known[j][found] == key), found, -1)
    return at


def in_order(level: Level, known: list[np.ndarray]) -> tuple[Level, np.ndarray]:
    """The level in the order of its keys, and the keys: place of the phrase without its last word, and that word."""
    prefix = place(level.words[:, :-1], known) if level.words.shape[1] > 1 else np.zeros(len(level.words), np.int64)
    kinds = int(level.words[:, -1].max(initial=0)) + 1
    key, order = sorted_places(prefix * kinds + level.words[:, -1], (int(prefix.max(initial=0)) + 1) * kinds)
    return level.only(order), key // kinds * (1 << 32) + key % kinds


# Shards --------------------------------------------------------------------------


@dataclass
class _Collected:
    """Texts of one language on their way into a shard."""

    parts: list[np.ndarray]
    values: list[pa.Array]
    held: int = 0


def _renumbered(ids: np.ndarray, values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ids 1.. into those of ``values`` that occur; 0 stays."""
    used, inner = np.unique(ids, return_inverse=True)
    return np.where(used > 0, np.cumsum(used > 0), 0)[inner], values.take(pa.array(used[used > 0] - 1))


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids as four planes, lowest bytes first: the upper ones are nearly all zeros, which compresses better apart."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_ids(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``shard, lang, n_words, vocabulary, ids``: word ids, from which an index is built, per run of documents of a language.

    Made where the documents lie. A shard is cut between pieces once it holds ``shard_words`` words; only
    a piece longer than that makes it larger.
    """
    text = lambda c, other: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(other))
    rows = docs.select(text(lang_col, "und").alias("lang"), text(text_col, "").alias("text"))
    names = ["shard", "lang", "n_words", "vocabulary", "ids"]

    def finished(number: int, lang: str, held: _Collected, last: bool) -> Iterator[pa.RecordBatch]:
        ids, values = np.concatenate([[0], *held.parts]), pa.concat_arrays(held.values)
        stop = len(ids)
        if not last:
            # What follows the last separator within the size stays for the next shard.
            breaks = np.flatnonzero(ids[1:] == 0) + 1
            within = np.searchsorted(breaks, shard_words, side="right")
            stop = int(breaks[max(within - 1, 0)]) + 1
        rest, ids = ids[stop:], ids[:stop]
        held.held = int((rest > 0).sum())
        kept, kept_values = _renumbered(rest, values)
        held.parts, held.values = ([kept], [kept_values]) if held.held else ([], [])
        ids, values = _renumbered(ids, values)
        encoded = values.dictionary_encode()
        ids = np.append(0, encoded.indices.to_numpy() + 1)[ids]
        n_words = int((ids > 0).sum())
        if n_words:
            columns = [
                pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                pa.array([lang]),
                pa.array([n_words], pa.int64()),
                pa.array([b"\n".join(encoded.dictionary.to_pylist())], pa.binary()),
                pa.array([packed_ids(ids)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Collected] = {}
        number = 0
        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                data, at = ragged.utf8(part.column("text"))
                pieces = ragged.cut(_FOLD[data], at, _CUTS)
                first, _ = ragged.flat(pieces.values)
                starts = ragged.flat(pieces.values)[1][:-1]
                kind = _KIND[first[starts]] if len(starts) else np.zeros(0, np.uint8)
                code = np.where(kind == 0, np.arange(1, len(kind) + 1), 0)[pieces.code] if len(kind) else np.zeros(0, np.int64)
                solid = (kind != 2)[pieces.code] if len(kind) else np.zeros(0, bool)
                code, row = code[solid], pieces.row[solid]
                lang = part.column("lang").dictionary_encode()
                of_row = lang.indices.to_numpy()
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    mine = of_row[row] == k if len(row) else np.zeros(0, bool)
                    own, doc = code[mine], row[mine]
                    if not (own > 0).any():
                        continue
                    _, doc = np.unique(doc, return_inverse=True)
                    spread = np.zeros(len(own) + int(doc[-1]) + 1, dtype=np.int64)
                    spread[np.arange(len(own)) + doc] = own
                    held = open_.setdefault(name, _Collected([], []))
                    base = sum(len(v) for v in held.values)
                    spread, values = _renumbered(spread, pieces.values)
                    held.values.append(values)
                    held.parts.append(np.where(spread > 0, spread + base, 0))
                    held.held += int((spread > 0).sum())
                    while held.held >= shard_words:
                        yield from finished(number, name, held, last=False)
                        number += 1
        for name, held in open_.items():
            if held.held:
                yield from finished(number, name, held, last=True)
                number += 1

    return rows.mapInArrow(run, "shard bigint, lang string, n_words bigint, vocabulary binary, ids binary")


def _bucketed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``rows`` once by buckets of ``key`` below the shared folder: joins on it leave these rows where they are."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", scratch_path(spark, name))
    writer.saveAsTable(table)
    return spark.table(table)


# Levels --------------------------------------------------------------------------


class _Shard:
    """One row of the shard table, opened."""

    def __init__(self, row: pa.Table, depth: int):
        self.shard = row.column("shard")[0].as_py()
        self.lang = row.column("lang")[0].as_py()
        self.vocabulary = pa.array([b"", *row.column("vocabulary")[0].as_py().split(b"\n")], pa.large_binary())
        self.index = TextIndex(unpacked_ids(row.column("ids")[0].as_py()), depth)
        seed = ragged.hash64(pa.array([self.lang.encode()], pa.large_binary()))[0]
        self.hashes = ragged.hash64(self.vocabulary) ^ seed

    def keys(self, level: Level) -> np.ndarray:
        """64-bit hash of each phrase and its language, the same in every shard."""
        out = np.zeros(len(level.words), np.uint64)
        weight = ragged.powers(level.words.shape[1] + 1)
        for k in range(level.words.shape[1]):
            out += self.hashes[level.words[:, k]] * weight[k + 1]
        return ragged.finish(out + np.uint64(level.words.shape[1]))

    def levels(self, flags: dict[int, dict[int, bytes]], upto: int, parts: int) -> Iterator[Level]:
        """Phrases of 1 to ``upto`` words; those of a length with flags only where the flag is set."""
        level, known = self.index.words(), []
        for length in range(1, upto + 1):
            level, key = in_order(self.index.longer(level, known) if length > 1 else level, known)
            if length in flags:
                keep = np.zeros(len(level.words), dtype=bool)
                for part, at in _by_part(self.keys(level), parts):
                    keep[at] = np.unpackbits(np.frombuffer(flags[length][part], np.uint8), count=len(at)).astype(bool)
                level, key = level.only(keep), key[keep]
            known.append(key)
            yield level


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each part, ascending."""
    part = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(first)).tolist():
        yield k, order[first[k] : first[k + 1]]


def _flags_of(rows: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for length, part, bits in zip(*[rows.column(c).to_pylist() for c in ("length", "part", "bits")]):
        out.setdefault(length, {})[part] = bits
    return out


def _frequent(indexed: DataFrame, flags: DataFrame, length: int, least: int, parts: int) -> DataFrame:
    """``shard, length, part, bits``: which of a shard's phrases of ``length`` words occur ``least`` times in all shards.

    Only hashes and counts of phrases are shuffled, and a bit each comes back. Phrases whose hashes are
    alike are added up, so a bit may be set for too rare a phrase, never the other way round. The lower half of
    a hash names its part, the upper half tells the phrases of a part apart, of which there are some millions at
    any input size. Counts go up to ``least``, which is all that decides.
    """
    narrow = np.min_scalar_type(max(least, 1))

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        # Only intervals of phrases shorter than ``length`` are extended, so the transforms need no deeper sort.
        own = _Shard(left, max(length - 1, 1))
        *_, level = own.levels(_flags_of(right), length, parts)
        keys = own.keys(level)
        upper, counts = (keys >> np.uint64(32)).astype(np.uint32), np.minimum(level.count, max(least, 1)).astype(narrow)
        found = [(k, upper[at].tobytes(), counts[at].tobytes()) for k, at in _by_part(keys, parts)]
        return pa.table(
            {
                "part": pa.array([k for k, _, _ in found], pa.int32()),
                "shard": pa.array([own.shard] * len(found), pa.int64()),
                "keys": pa.array([x for _, x, _ in found], pa.binary()),
                "counts": pa.array([x for _, _, x in found], pa.binary()),
            }
        )

    def decide(group: pa.Table) -> pa.Table:
        size = np.array([len(x) // 4 for x in group.column("keys").to_pylist()], np.int64)
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), narrow)
        _, inner = np.unique(keys, return_inverse=True)
        often = (np.bincount(inner, weights=counts) >= least)[inner]
        ends = np.cumsum(size)
        return pa.table(
            {
                "shard": group.column("shard").combine_chunks(),
                "length": pa.array([length] * len(size), pa.int32()),
                "part": group.column("part").combine_chunks(),
                "bits": pa.array([np.packbits(often[b - n : b]).tobytes() for b, n in zip(ends, size)], pa.binary()),
            }
        )

    reported = indexed.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(report, "part int, shard bigint, keys binary, counts binary")
    return stored(reported.groupBy("part").applyInArrow(decide, "shard bigint, length int, part int, bits binary"), "flags")


def phrase_counts(
    docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``most_words`` words with ``least`` occurrences in their language, and the words per language.

    ``lang, phrase, n_words, f, left_f, right_f``: occurrences, and those with a word of the same piece to the
    left, to the right. ``lang, n``: all word occurrences. Each shard enumerates its phrases length by length
    and extends only phrases that are frequent over all shards, whose other part is frequent too; the
    counts of those are summed exactly by their words.
    """
    indexed = _bucketed(shards(docs, shard_words, lang_col, text_col), "shard", "indexes")
    totals = stored(indexed.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = int(words // PART_ENTRIES) + 1
    spark = docs.sparkSession
    flags = spark.createDataFrame([], "shard bigint, length int, part int, bits binary")
    for length in range(1, most_words + 1):
        flags = flags.unionByName(_frequent(indexed, flags, length, least, parts))

    def phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Shard(left, most_words)
        out = []
        for level in own.levels(_flags_of(right), most_words, parts):
            columns = [own.vocabulary.take(pa.array(level.words[:, k])) for k in range(level.words.shape[1])]
            text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if len(columns) > 1 else columns[0]
            before, after = own.index.neighbours(level)
            out.append(
                pa.table(
                    {
                        "lang": pa.array([own.lang] * len(text), pa.string()),
                        "phrase": text.cast(pa.binary()).cast(pa.string()),
                        "n_words": pa.array(np.full(len(text), len(columns)), pa.int32()),
                        "f": pa.array(level.count.astype(np.int64)),
                        "left_f": pa.array(before.astype(np.int64)),
                        "right_f": pa.array(after.astype(np.int64)),
                    }
                )
            )
        return pa.concat_tables(out)

    kinds = "lang string, phrase string, n_words int, f bigint, left_f bigint, right_f bigint"
    found = indexed.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(phrases, kinds)
    summed = found.groupBy("lang", "phrase", "n_words").agg(*[F.sum(c).alias(c) for c in ("f", "left_f", "right_f")])
    return stored(summed.where(F.col("f") >= least), "phrases"), totals


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, top: int = TOP, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Each language's ``top`` phrases by how much more often their parts meet than their counts explain.

    A candidate has 2 to ``most_words`` words and ``least`` occurrences. Cut into two parts with l and r
    occurrences it scores ``floor(10^6 a^2 / (l r))``; the cut with the least score counts, the first of equal
    ones. Candidates inside a longer one with half of their occurrences go: extensions only lose
    occurrences, so those by one word decide. Order: score, occurrences, phrase by UTF-8 bytes.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and into words at blanks.
    A null language is ``und``, a null text empty. Repeated rows count each time. Texts without words, an
    empty table and languages without candidates give no rows. Extra columns are ignored.

    Returns ``lang, rank, phrase, a, l, r, n, score, left_f, right_f``.
    """
    counted, totals = phrase_counts(docs, least, most_words, lang_col, text_col, shard_words)
    candidates = counted.where("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"), "left_f", "right_f")
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")

    inner = candidates.where("n_words >= 3").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("n_words") - 1), joined(F.lit(2), F.col("n_words") - 1))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < COVER_PERCENT * F.col("a")))

    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cut = cut.withColumn("first", joined(F.lit(1), F.col("k"))).withColumn("rest", joined(F.col("k") + 1, F.col("n_words") - F.col("k")))
    spread = F.pmod(F.xxhash64("phrase"), F.lit(COPIES)).cast("int")
    cut = cut.withColumn("copy_first", F.when(F.col("k") == 1, spread).otherwise(0)).withColumn("copy_rest", F.when(F.col("n_words") - F.col("k") == 1, spread).otherwise(0))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("n_words") == 1, COPIES - 1).otherwise(0)))
    counts = counted.where(F.col("n_words") < most_words).select("lang", "phrase", "f", copies.alias("copy"))
    for part, name in (("first", "l"), ("rest", "r")):
        side = counts.select("lang", F.col("phrase").alias(part), F.col("copy").alias(f"copy_{part}"), F.col("f").alias(name))
        cut = cut.join(side, ["lang", part, f"copy_{part}"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumn("above", wide("a") * wide("a")).withColumn("below", wide("l") * wide("r"))
    cut = cut.withColumn("score", F.expr(f"cast((cast(above as decimal(31,0)) * cast({SCALE} as decimal(7,0))) div below as bigint)"))
    scored = cut.groupBy("lang", "phrase", "a", "left_f", "right_f").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score", "left_f", "right_f")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Bands of the score are counted first: what has ``top`` better candidates in higher bands goes where it lies. Ties may
    # fill a band, but the first of a language are among the first of each of its shares, so no task sorts a whole language.
    scored = stored(scored.withColumn("band", F.floor(F.log2(F.col("score") + 1) * BANDS)), "scored")
    higher = Window.partitionBy("lang").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = scored.groupBy("lang", "band").agg(F.count("*").alias("size")).withColumn("better", F.coalesce(F.sum("size").over(higher), F.lit(0)))
    reach = bands.where(F.col("better") < top).groupBy("lang").agg(F.min("band").alias("reach"))
    scored = scored.join(pinned(reach), "lang").where(F.col("band") >= F.col("reach"))
    scored = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    scored = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score", "left_f", "right_f")


COLLOCATION_SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
phrases AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, i, w
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)
),
f AS (
  SELECT lang, m, phrase, count(*) AS f, count(*) FILTER (i > 1) AS left_f, count(*) FILTER (i + m - 1 < len(w)) AS right_f
  FROM phrases GROUP BY lang, m, phrase HAVING count(*) >= {LEAST_COUNT}
),
around AS (
  SELECT lang, part, max(f) AS f FROM (SELECT lang, f, string_split(phrase, ' ') AS w, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM f WHERE m = 3)
  GROUP BY lang, part
),
kept AS (SELECT f.* FROM f LEFT JOIN around ON around.lang = f.lang AND around.part = f.phrase WHERE m >= 2 AND (around.f IS NULL OR 100 * around.f < {COVER_PERCENT} * f.f)),
cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.left_f, c.right_f, x.f AS l, y.f AS r, k,
    (({SCALE}::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score, left_f, right_f
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN totals USING (lang)
WHERE rank <= {TOP}
"""
