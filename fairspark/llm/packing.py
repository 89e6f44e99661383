"""Order-preserving packing of token streams by dynamic programming over cut positions."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm import ragged

#: Tokens of one dynamic program; the open end is carried into the next one.
STREAM_TOKENS = 1 << 20
#: A cut inside a document costs as much as so many padding tokens: after a sentence, elsewhere.
SENTENCE_PENALTY = 8
INNER_PENALTY = 48
#: Distance of the allowed cuts that are not at a boundary.
GRID = 64
#: Words that the library encodes as one line, and bytes of text that are cut at a time.
LINE_WORDS = 64
SLICE_BYTES = 8 << 20
#: Words kept with their ids in a worker before the memory is started anew.
REMEMBERED = 600_000

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_A, _B = np.arange(65536) >> 8, np.arange(65536) & 255
#: Pre-tokens end at white space and between ASCII letters, digits and signs; apostrophes and other scripts stay whole.
WORD_CUTS = ragged.SPACE_CUTS | ((_CLASS[_A] != _CLASS[_B]) & (_CLASS[_A] > 0) & (_CLASS[_B] > 0))


class WordIds:
    """Token ids of texts under a word-splitting BPE tokenizer, each distinct word encoded once per worker."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            if token.removesuffix("</w>")[-1:] in (".", "!", "?") and token.endswith("</w>"):
                self.ends_sentence[i] = True
        self.stop_id = self.tokenizer.encode("a .", add_special_tokens=False).ids[-1]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _rows(self, values: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        fresh = [v for v in values if v not in known]
        if fresh:
            # Words without a full stop go through the library in lines, with full stops between them.
            plain = [v for v in fresh if b"." not in v]
            dotted = [v for v in fresh if b"." in v]
            flat, length = self._in_lines(plain)
            found = [e.ids for e in self.tokenizer.encode_batch_fast([v.decode() for v in dotted], add_special_tokens=False)] if dotted else []
            length = np.append(length, np.fromiter(map(len, found), np.int64, len(found)))
            flat = np.append(flat, np.fromiter(chain.from_iterable(found), np.uint32))
            known.update(zip(plain + dotted, range(len(self.length), len(self.length) + len(fresh))))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.ids = np.append(self.ids, flat)
        return np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))

    def _in_lines(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each.

        A full stop between blanks is always the same one id, and no word here holds any, so it parts them.
        """
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lines = [b" . ".join(words[i : i + LINE_WORDS]).decode() + " ." for i in range(0, len(words), LINE_WORDS)]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        stops = np.flatnonzero(ids == self.stop_id)
        assert len(stops) == len(words)
        return ids[ids != self.stop_id], np.diff(stops, prepend=-1) - 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text, its end id included."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        whole = {}
        if self.special and pc.any(odd := pc.match_substring_regex(column, self.special)).as_py():
            # Special strings inside a text are one token for the library; such texts go through it whole.
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                whole[int(i)] = np.array(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            column = pc.if_else(odd, "", column)
        data, at = ragged.utf8(column)
        pieces = ragged.cut(ragged.LOWER[data], at, WORD_CUTS, skip_spaces=True)
        rows = self._rows(pieces.values.to_pylist())
        row = rows[pieces.code] if len(pieces) else np.zeros(0, np.int64)
        at_rows = pieces.row_offsets()
        sizes, places = self.length[row], self.start[row]
        upto = np.append(0, np.cumsum(sizes))
        per_text = np.diff(upto[at_rows])
        index = np.repeat((places - upto[:-1]).astype(np.int32), sizes)
        index += np.arange(len(index), dtype=np.int32)
        ids = self.ids.take(index)
        extra = np.array([len(whole.get(i, ())) for i in range(len(column))], np.int64) if whole else 0
        offsets = np.append(0, np.cumsum(per_text + extra + 1))
        out = np.full(int(offsets[-1]), self.end_id, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[offsets[1:] - 1] = False
        for i, own in whole.items():
            out[offsets[i] : offsets[i] + len(own)] = own
            inside[offsets[i] : offsets[i] + len(own)] = False
        out[inside] = ids
        return out, offsets


@lru_cache(maxsize=2)
def word_ids(path: str, end_id: int) -> WordIds:
    # A task has one core: the library's threads would only wait for each other.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path, end_id)


def window_cuts(position: list[int], penalty: list[int], width: int, last: bool) -> list[int]:
    """Cheapest window ends among ``position`` (ascending, the last one is the end of the stream).

    A window costs its padding to ``width``, a cut its penalty. ``best[j] + position[j]`` sits in a
    monotone queue, so the cheapest earlier cut within reach is its head: linear time. Without
    ``last`` the final window stays open and the cheapest start of it ends the list.
    """
    n = len(position)
    value = [0] * (n + 1)  # cost of the best windows that end here, plus the position
    source = [0] * (n + 1)
    queue: deque[int] = deque([0])
    at = [0, *position]
    for j in range(1, n + 1):
        here = at[j]
        while here - at[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        source[j] = i
        value[j] = value[i] + width + penalty[j - 1]
        while queue and value[queue[-1]] >= value[j]:
            queue.pop()
        queue.append(j)
    end, first = at[n], n - 1
    while first >= 0 and end - at[first] <= width:
        first -= 1
    reach = range(first + 1, n)
    if last:
        # The tail needs no padding as windows whose lengths are powers of two.
        def tail(i: int) -> int:
            left = end - at[i]
            return min(width - left, INNER_PENALTY * (left.bit_count() - 1))

        j = min(reach, key=lambda i: value[i] - at[i] + tail(i))
    else:
        j = min(reach, key=lambda i: value[i])
    cuts = []
    while j > 0:
        cuts.append(at[j])
        j = source[j]
    cuts.reverse()
    if last:
        begin = cuts[-1] if cuts else 0
        left = end - begin
        if 0 < width - left > INNER_PENALTY * (left.bit_count() - 1):
            for bit in range(left.bit_length() - 1, -1, -1):
                if left >> bit & 1:
                    begin += 1 << bit
                    cuts.append(begin)
        elif left:
            cuts.append(end)
    return cuts


@dataclass
class Stream:
    """Documents of one task in arrival order, packed piece by piece."""

    words: WordIds
    width: int
    sequence: int
    ids: list[np.ndarray] = field(default_factory=list)
    doc: list = field(default_factory=list)  # one entry per document that still has ids here
    size: list[int] = field(default_factory=list)  # its ids in the stream
    used: list[int] = field(default_factory=list)  # its ids before the stream
    held: int = 0

    def add(self, docs: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc += docs
        self.size += np.diff(offsets).tolist()
        self.used += [0] * len(docs)
        self.held += len(ids)

    def pack(self, last: bool) -> dict | None:
        if not self.held:
            return None
        ids = np.concatenate(self.ids)
        size = np.array(self.size, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1])
        sentence = np.flatnonzero(self.words.ends_sentence[np.minimum(ids, len(self.words.ends_sentence) - 1)]) + 1
        where = np.concatenate([ends, sentence, np.arange(GRID, total, GRID)])
        cost = np.concatenate([np.zeros(len(ends), np.int64), np.full(len(sentence), SENTENCE_PENALTY), np.full(len(where) - len(ends) - len(sentence), INNER_PENALTY)])
        order = np.lexsort((cost, where))
        where, cost = where[order], cost[order]
        first = np.append(True, where[1:] != where[:-1])
        cuts = window_cuts(where[first].tolist(), cost[first].tolist(), self.width, last)
        if not cuts:
            return None
        stop = cuts[-1]
        begins = np.append(0, ends[:-1])
        edges = np.unique(np.concatenate([[0], cuts, begins[begins < stop], ends[ends < stop]]))
        lo, hi = edges[:-1], edges[1:]
        window_ends = np.array(cuts)
        window = np.searchsorted(window_ends, lo, side="right")
        window_starts = np.append(0, window_ends[:-1])
        owner = np.searchsorted(ends, lo, side="right")
        used = np.array(self.used, np.int64)
        raw = np.ascontiguousarray(ids[:stop].astype("<u4"))
        out = {
            "id": [self.doc[i] for i in owner],
            "start": used[owner] + lo - begins[owner],
            "length": hi - lo,
            "ids": (raw, np.append(lo, stop)),
            "doc_tokens": (used + size)[owner],
            "sequence_id": self.sequence + window,
            "offset": lo - window_starts[window],
        }
        # doc_tokens of a document whose rest is still to come is right too: its ids are all in the stream.
        self.sequence += len(cuts)
        keep = int(np.searchsorted(ends, stop, side="right"))
        rest = size[keep:].copy()
        left = used[keep:].copy()
        if keep < len(size):
            taken = max(0, stop - int(begins[keep]))
            rest[0] -= taken
            left[0] += taken
        self.ids, self.doc, self.size, self.used, self.held = [ids[stop:]], self.doc[keep:], rest.tolist(), left.tolist(), total - stop
        return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    width: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """Documents cut into sequences of at most ``width`` tokens, in the order of each input partition.

    Window ends are chosen among document ends, sentence ends and a grid, minimising padding plus
    truncation penalties. Each task packs its own documents, so nothing is shuffled; memory is one
    stream of about a million tokens. A task's last window is split into powers of two where that is
    cheaper than padding. ``tokenizer_path`` has to exist on the executors.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed like others;
    extra columns are ignored. ``sequence_id`` is the task's number times 2^32 plus a counter.

    Returns per piece ``id_col, start, length, ids, doc_tokens, sequence_id, offset``; with
    ``digest`` the ids are replaced by ``ids_crc32``, the checksum of the ids as 32-bit integers.
    """
    if width & (width - 1):
        raise ValueError("width has to be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def record(found: dict, kind: pa.DataType) -> pa.RecordBatch:
        raw, at = found["ids"]
        if digest:
            view = memoryview(raw).cast("B")
            ids = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
        else:
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(raw.astype(np.int32)))
        columns = [pa.array(found["id"], kind), pa.array(found["start"]), pa.array(found["length"]), ids]
        columns += [pa.array(found[c], pa.int64()) for c in ("doc_tokens", "sequence_id", "offset")]
        return pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path, end_id)
        stream = Stream(words, width, TaskContext.get().partitionId() << 32)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                stream.add(part.column("id").to_pylist(), *words.encode(part.column("text")))
                while stream.held >= STREAM_TOKENS and (found := stream.pack(last=False)):
                    yield record(found, kind)
        if found := stream.pack(last=True):
            yield record(found, kind)

    kind = rows.schema["id"].dataType.simpleString()
    content = "ids_crc32 bigint" if digest else "ids array<int>"
    packed = rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, {content}, doc_tokens bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
