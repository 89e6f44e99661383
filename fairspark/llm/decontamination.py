"""Benchmark passages inside documents, found by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm import ragged

#: Tokens of a seed, which is the shortest tile.
SEED_TOKENS = 5
#: Share of a test item's tokens that tiles must cover.
COVERAGE = 0.5
#: Benchmark bytes on the executors at a time; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
_INVERSE = np.uint64(pow(int(ragged.powers(2)[1]), -1, 1 << 64))
#: Signs at the ends of a word do not count.
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


@dataclass
class SeedIndex:
    """All seeds of a block of items: hash, item, position, sorted by hash; and the items' tokens."""

    ids: list
    tokens: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    position: np.ndarray
    near: np.ndarray  # one bit per hash prefix, to skip almost all look-ups


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and the row offsets: lower-case words without signs at their ends."""
    found = ragged.words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    bare = pc.replace_substring_regex(found.values.cast(pa.large_string()), _EDGES, "")
    filled = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    hashed = ragged.hash64(pa.array(bare).cast(pa.large_binary()))
    keep = filled[found.code] if len(found) else np.zeros(0, bool)
    row = found.row[keep]
    return hashed[found.code[keep]], np.searchsorted(row, np.arange(found.n_rows + 1))


def build_index(ids: list, texts: list[str | None], width: int = SEED_TOKENS) -> SeedIndex:
    """Seeds of the items. An item shorter than a seed has none and is never matched."""
    flat, at = tokens(pa.array(texts, pa.large_string()))
    parts = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    seeds = [ragged.window_hashes(p, width) for p in parts]
    seed = np.concatenate([np.zeros(0, np.uint64), *seeds])
    item = np.repeat(np.arange(len(parts)), [len(s) for s in seeds])
    position = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(s)) for s in seeds]]).astype(np.int64)
    order = np.argsort(seed, kind="stable")
    near = np.zeros(1 << _FILTER_BITS, dtype=bool)
    near[(seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return SeedIndex(ids, parts, seed[order], item[order], position[order], near)


class _Side:
    """Tokens below shared seeds on one side of a comparison, the marks on them and their running hashes."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, least: int):
        steps = np.minimum(np.diff(starts, append=starts[-1] + least), least)
        self.place = ragged.gather(starts, steps)
        self.tokens = tokens[self.place]
        n = len(self.place)
        self.scale = ragged.powers(n + 1)
        self.unscale = ragged.powers(n + 1, _INVERSE)
        self.running = np.append(np.zeros(1, np.uint64), np.cumsum(self.tokens * self.scale[:n], dtype=np.uint64))
        self.free = np.ones(n, dtype=bool)
        self.gap = np.diff(self.place, append=self.place[-1] + 2) != 1
        self.measure()

    def measure(self) -> None:
        """How many free tokens follow each place, itself included."""
        n = len(self.place)
        border = self.gap | ~self.free
        border[:-1] |= ~self.free[1:]
        ends = np.where(border, np.arange(1, n + 1), n)
        self.room = np.where(self.free, np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n), 0)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all free windows and their hashes."""
        at = np.flatnonzero(self.room >= width)
        return at, (self.running[at + width] - self.running[at]) * self.unscale[at]

    def is_free(self, at: int, width: int) -> bool:
        """Whether a window is still free of marks of its own length, which cover one of its ends."""
        return bool(self.free[at] and self.free[at + width - 1])


def _shared(a: _Side, b: _Side, width: int) -> bool:
    hashes = np.sort(b.windows(width)[1])
    own = a.windows(width)[1]
    return len(hashes) > 0 and bool((hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own).any())


def _longest(a: _Side, b: _Side, least: int, most: int) -> int:
    """Length of the longest free window on both sides, or 0: each length is tried by a running hash."""
    most = min(most, int(a.room.max()), int(b.room.max()))
    if most < least:
        return 0
    if _shared(a, b, most):
        return most
    low, high = least - 1, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _shared(a, b, middle) else (low, middle)
    return low if low >= least else 0


def tile(text: np.ndarray, item: np.ndarray, starts: np.ndarray, partners: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, item position, length) from the shared seeds of one text and one item.

    ``starts`` and ``partners`` are the places of shared seeds in the text and in the item, ascending. The
    longest match of free tokens is found by halving its length and hashing all free windows; all matches
    of that length are marked, earlier item positions first, then earlier text positions, each compared
    token by token before. Then the next shorter length follows. Tiles never overlap in the text or the
    item. No pair of places is ever listed, so memory is linear in both however often a seed repeats.
    """
    n, s, p = len(starts), int(starts[0]), int(partners[0])
    if n == len(partners) and starts[-1] - s == n - 1 == partners[-1] - p:
        if np.array_equal(text[s : s + n + least - 1], item[p : p + n + least - 1]):
            return [(s, p, n + least - 1)]  # one unbroken passage on both sides is one tile
    a, b = _Side(text, starts, least), _Side(item, partners, least)
    tiles = []
    width = _longest(a, b, least, len(item))
    while width:
        at, partner_hash = b.windows(width)
        known, code = np.unique(partner_hash, return_inverse=True)
        own, own_hash = a.windows(width)
        slot = np.minimum(np.searchsorted(known, own_hash), len(known) - 1)
        hit = known[slot] == own_hash
        own, slot = own[hit], slot[hit]
        own = own[np.argsort(slot, kind="stable")]
        last = np.cumsum(np.bincount(slot, minlength=len(known)))
        turn = last - np.bincount(slot, minlength=len(known))
        with_some = turn[code] < last[code]
        for p, c in zip(at[with_some].tolist(), code[with_some].tolist()):
            while b.is_free(p, width) and turn[c] < last[c]:
                s = int(own[turn[c]])
                turn[c] += 1
                if a.is_free(s, width) and np.array_equal(a.tokens[s : s + width], b.tokens[p : p + width]):
                    a.free[s : s + width] = False
                    b.free[p : p + width] = False
                    tiles.append((int(a.place[s]), int(b.place[p]), width))
        a.measure()
        b.measure()
        width = _longest(a, b, least, width - 1)
    return tiles


def match_text(text: np.ndarray, index: SeedIndex, least: int = SEED_TOKENS, coverage: float = 0.0) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Items that share a seed with the text, with their tiles. ``text`` are token hashes.

    An item whose shared seeds reach less than ``coverage`` of its tokens cannot be covered so far by tiles
    and is passed over. Each distinct seed is looked up once.
    """
    rolled = ragged.window_hashes(text, least)
    at = np.flatnonzero(index.near[(rolled >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    seeds, code = np.unique(rolled[at], return_inverse=True)
    lo = np.searchsorted(index.seed, seeds, side="left")
    hits = np.searchsorted(index.seed, seeds, side="right") - lo
    if not hits.any():
        return
    places = at[np.argsort(code, kind="stable")]
    often = np.bincount(code, minlength=len(seeds))
    first = np.cumsum(often) - often
    entry, of = ragged.gather(lo, hits), np.repeat(np.arange(len(seeds)), hits)
    order = np.lexsort((index.position[entry], index.item[entry]))
    of, position, item = of[order], index.position[entry[order]], index.item[entry[order]]
    begin = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    end = np.append(begin[1:], len(item))
    reach = np.minimum(np.diff(position, append=0), least)
    reach[end - 1] = least
    for k, i, j, most in zip(item[begin].tolist(), begin.tolist(), end.tolist(), np.add.reduceat(reach, begin).tolist()):
        if most >= coverage * len(index.tokens[k]):
            own = np.unique(of[i:j])
            starts = np.sort(places[ragged.gather(first[own], often[own])])
            yield k, tile(text, index.tokens[k], starts, position[i:j], least)


def _blocks(spark, items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded size: by hash, as many blocks as their bytes need."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    for k in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        yield [r["id"] for r in found], [r["text"] for r in found]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    least: int = SEED_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a test item of which tiles cover at least ``coverage``.

    Tokens are lower-case words without signs at their ends. Tiles may come in any order, so a
    passage with its sentences dealt anew is found as well. The benchmark goes to the executors in
    blocks of ``BLOCK_BYTES``; documents are scanned where they lie, without a shuffle, however many of
    them share a passage.

    Null or empty documents and items match nothing, nor do items shorter than ``least`` tokens.
    Repeated documents and items each give their own rows; ties between matches go to the earlier item
    position, then the earlier text position. Extra columns are ignored.

    Returns ``id_col, item_id_col, n_tiles, covered, item_tokens, coverage, tiles``; a tile is
    (text token, item token, tokens).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    doc_kind = rows.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    schema = f"id {doc_kind}, item {item_kind}, n_tiles int, covered int, item_tokens int, tiles array<struct<at:int,item_at:int,n:int>>"
    tile_kind = pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("n", pa.int32())]))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in ragged.slices(batch, "text"):
                    flat, at = tokens(part.column("text"))
                    found = []
                    # One look-up for the whole slice tells which texts hold a seed at all.
                    rolled = ragged.window_hashes(flat, least)
                    hit = np.flatnonzero(index.near[(rolled >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                    for i in np.unique(np.searchsorted(at, hit, side="right") - 1):
                        for k, tiles in match_text(flat[at[i] : at[i + 1]], index, least, coverage):
                            covered, size = sum(n for _, _, n in tiles), len(index.tokens[k])
                            if tiles and covered >= coverage * size:
                                found.append((int(i), k, len(tiles), covered, size, [dict(at=a, item_at=b, n=n) for a, b, n in tiles]))
                    if found:
                        i, k, n, c, s, t = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("id").take(pa.array(i)),
                                pa.array([index.ids[x] for x in k]),
                                *[pa.array(x, pa.int32()) for x in (n, c, s)],
                                pa.array(t, tile_kind),
                            ],
                            names=["id", "item", "n_tiles", "covered", "item_tokens", "tiles"],
                        )

        return rows.mapInArrow(run, schema)

    out = None
    for ids, texts in _blocks(spark, benchmark, item_id_col, item_text_col):
        part = scan(spark.sparkContext.broadcast(build_index(ids, texts, least)))
        out = part if out is None else out.unionByName(part)
    return out.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id_col if item_id_col != id_col else f"item_{item_id_col}"),
        "n_tiles",
        "covered",
        "item_tokens",
        (F.col("covered") / F.col("item_tokens")).alias("coverage"),
        "tiles",
    )
