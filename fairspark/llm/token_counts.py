"""Token counts of a piece model by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm import ragged

NO_RANK = np.iinfo(np.int32).max
#: Pre-tokens longer than this are merged one by one from a heap, in n log n steps instead of n rounds.
LONGEST_ROUND = 256


class PieceRanks:
    """Merge table of a byte-fallback BPE piece model.

    ``cuts`` marks byte pairs that no piece contains: nothing merges across them, so a text may be
    taken apart there and every pre-token counted on its own.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model_pb2.ModelProto()
        proto.ParseFromString(loaded.serialized_model_proto())
        rules = proto.normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if not plain or proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("needs a BPE piece model with byte fallback and identity normalisation")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not merged by rank")
        self.prefix = b" " if rules.add_dummy_prefix else b""
        pieces = {p.piece.replace("▁", " "): p.score for p in proto.pieces if p.type == p.NORMAL}
        symbols = {s: i for i, s in enumerate(pieces)}
        for s in pieces:
            for c in s:
                symbols.setdefault(c, len(symbols))
        self.n = len(symbols) + 4
        self.cost = np.ones(self.n, dtype=np.int64)
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
                if s not in pieces:
                    self.cost[i] = len(s.encode())
        # Characters that no piece knows: they never merge and cost their bytes.
        points = np.arange(0x110000)
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        unknown = self.symbol < 0
        self.symbol[unknown] = (len(symbols) + size - 1)[unknown]
        self.cost[len(symbols) :] = [1, 2, 3, 4]
        order = {score: k for k, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        merges = [
            (symbols[s[:k]] * self.n + symbols[s[k:]], order[score], symbols[s])
            for s, score in pieces.items()
            for k in range(1, len(s))
            if s[:k] in symbols and s[k:] in symbols
        ]
        table = np.array(sorted(merges), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        inside = np.zeros(65536, dtype=bool)
        for s in pieces:
            raw = s.encode()
            for a, b in zip(raw, raw[1:]):
                inside[a * 256 + b] = True
        self.cuts = ~inside & ~ragged.IS_TAIL[np.arange(65536) & 255]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of adjacent symbols; ``NO_RANK`` where they do not merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.merged[at]

    def count(self, values: pa.Array) -> np.ndarray:
        """Tokens of each pre-token (bytes, spaces unescaped)."""
        data, at = ragged.flat(values)
        if not len(values):
            return np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        heads = np.append(0, np.cumsum(~ragged.IS_TAIL[data]))[at]
        lengths = np.diff(heads)
        symbols = self.symbol[points]
        out = np.zeros(len(values), np.int64)
        short = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_ROUND))
        out[short] = self._rounds(symbols[ragged.gather(heads[short], lengths[short])], lengths[short])
        for i in np.flatnonzero(lengths > LONGEST_ROUND):
            out[i] = self._heap(symbols[heads[i] : heads[i + 1]].tolist())
        return out

    def _rounds(self, sym: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All sequences at once: each round merges the first lowest-rank pair of every sequence."""
        total = np.zeros(len(lengths), np.int64)
        if not len(lengths):
            return total
        seq = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(sym), NO_RANK, dtype=np.int32)
        into = np.zeros(len(sym), dtype=np.int32)
        same = seq[:-1] == seq[1:]
        r, m = self.look_up(sym[:-1], sym[1:])
        rank[:-1][same], into[:-1] = r[same], m
        while len(sym):
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(start, len(sym)))
            lowest = np.minimum.reduceat(rank, start)
            live = lowest != NO_RANK
            if not live.all():
                ended = ~live
                total[seq[start[ended]]] = np.add.reduceat(self.cost[sym], start)[ended]
                keep = np.repeat(live, size)
                seq, sym, rank, into = seq[keep], sym[keep], rank[keep], into[keep]
                lowest, size = lowest[live], size[live]
                if not len(sym):
                    break
                start = np.append(0, np.cumsum(size)[:-1])
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            first = hit[np.append(True, seq[hit[1:]] != seq[hit[:-1]])]
            sym[first] = into[first]
            keep = np.ones(len(sym), dtype=bool)
            keep[first + 1] = False
            seq, sym, rank, into = seq[keep], sym[keep], rank[keep], into[keep]
            now = first - np.arange(len(first))
            rank[now] = NO_RANK
            for left in (now - 1, now):
                left = left[(left >= 0) & (left < len(sym) - 1)]
                left = left[seq[left] == seq[left + 1]]
                rank[left], into[left] = self.look_up(sym[left], sym[left + 1])
        return total

    def _heap(self, sym: list[int]) -> int:
        n = len(sym)
        arr = np.array(sym)
        ranks, into = self.look_up(arr[:-1], arr[1:])
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), into.tolist())) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0:
                    r, merged = self._pair(sym[left], sym[right])
                    if r != NO_RANK:
                        heapq.heappush(heap, (r, left, sym[left], sym[right], merged))
        return int(sum(self.cost[s] for s in sym if s >= 0))

    def _pair(self, a: int, b: int) -> tuple[int, int]:
        key = a * self.n + b
        at = int(np.searchsorted(self.keys, key))
        if at < len(self.keys) and self.keys[at] == key:
            return int(self.ranks[at]), int(self.merged[at])
        return NO_RANK, 0

    def count_texts(self, column: pa.Array) -> np.ndarray:
        # The escape sign itself counts as a space, as in the library.
        data, at = ragged.utf8(pc.replace_substring(column.cast(pa.large_string()), "\u2581", " "))
        lengths = np.diff(at)
        if self.prefix and len(data):
            # A space before every text that is not empty.
            starts = at[:-1][lengths > 0]
            data = np.insert(data, starts, np.uint8(32))
            at = at + np.append(0, np.cumsum(lengths > 0))
        pieces = ragged.cut(data, at, self.cuts)
        return pieces.per_row(self.count(pieces.values)).astype(np.int64)


@lru_cache(maxsize=2)
def piece_ranks(path: str) -> PieceRanks:
    return PieceRanks(path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text under a sentence-piece BPE model, without begin or end tokens.

    The column is cut into pre-tokens wherever the vocabulary cannot merge, equal pre-tokens of a
    slice are counted once, and each round applies the lowest-rank pair of every sequence at once.
    No shuffle; memory is a slice of about 8 MB of text (one longer text at a time).
    ``model_path`` has to exist on the executors.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, null ids and ties are kept row by
    row; extra columns are ignored, whatever their names.

    Returns ``id_col, n_bytes, n_tokens, over_limit``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = piece_ranks(model_path)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                n = ranks.count_texts(part.column("text"))
                _, at = ragged.utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
