"""Jaccard self-join on word shingles: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairspark.llm import ragged
from fairspark.llm.components import components
from fairspark.llm.tables import stored

SHINGLE_WORDS = 5
PERCENT = 80
#: Cells of the frequency table that orders shingles from rare to frequent.
CELLS = 1 << 20
_PARTS = 16
#: A shingle in a cell with more occurrences than this, and than ``HOT_TIMES`` the mean cell, is hot.
HOT_COUNT = 20_000
HOT_TIMES = 8
#: Cells whose parities bound the difference of two sets from below.
PARITY_BITS = 256
#: Classes of a shingle and length band that all others of it are compared with first.
HEADS = 2
#: Bits of the table that tells tasks which classes are compared; its size does not depend on the input.
CLASS_BITS = 1 << 27


def shingle_rows(column: pa.Array, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, none is empty."""
    found = ragged.words(column)
    hashed = ragged.hash64(found.values)[found.code] if len(found) else np.zeros(0, np.uint64)
    rolled = ragged.window_hashes(hashed, width)
    at = found.row_offsets()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            own = np.sort(rolled[lo : hi - width + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif hi > lo:
            yield ragged.window_hashes(hashed[lo:hi], hi - lo)
        else:
            yield hashed[:0]


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a set; equal sets have equal keys."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def cell_counts(rows: DataFrame, width: int) -> np.ndarray:
    """Occurrences of shingles by cell, over all texts: added up per task, then in two shuffled steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                found = ragged.words(part.column("text"))
                if len(found):
                    rolled = ragged.window_hashes(ragged.hash64(found.values)[found.code], width)
                    whole = found.row[: len(rolled)] == found.row[len(found) - len(rolled) :]
                    total += np.bincount(_cells(rolled[whole]), minlength=CELLS)
        blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(total, _PARTS)]
        salt = int(np.random.default_rng(abs(hash(blobs[0]))).integers(32)) if total.any() else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PARTS), pa.int32()), pa.array([salt] * _PARTS, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "salt", "blob"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(CELLS // _PARTS, dtype=np.int64), 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for blob in batch.column("blob"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "blob"])

    counted = rows.select("text").mapInArrow(count, "part int, salt int, blob binary")
    summed = counted.groupBy("part", "salt").applyInArrow(add, "part int, blob binary").groupBy("part").applyInArrow(add, "part int, blob binary")
    found = {r["part"]: np.frombuffer(zlib.decompress(bytes(r["blob"])), dtype=np.int64) for r in summed.collect()}
    return np.concatenate([found.get(k, np.zeros(CELLS // _PARTS, np.int64)) for k in range(_PARTS)])


def _signatures(rows: DataFrame, counts: np.ndarray, percent: int, width: int) -> DataFrame:
    """``id, n, cls, p0..p3, prefix, n_cold`` per row; the prefix only for the first row of a class in a task."""
    threshold = max(HOT_COUNT, HOT_TIMES * counts.mean())
    ranks = np.minimum(counts, 2**31 - 1).astype(np.uint64) << np.uint64(32)
    shared = rows.sparkSession.sparkContext.broadcast((ranks, float(threshold)))
    words = PARITY_BITS // 64
    names = [f"p{k}" for k in range(words)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                n, key, parity, prefix, cold = [], [], [], [], []
                for own in shingle_rows(part.column("text"), width):
                    n.append(len(own))
                    if not len(own):
                        key.append(None), parity.append([0] * words), prefix.append(None), cold.append(0)
                        continue
                    key.append(set_key(own))
                    bits = np.bincount(((own >> np.uint64(24)) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                    parity.append(np.packbits(bits.astype(np.uint8)).view("<i8").tolist())
                    if key[-1] in seen:
                        prefix.append(None), cold.append(0)
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key[-1])
                    size = len(own) - (percent * len(own) + 99) // 100 + 1
                    often = rank[_cells(own)]
                    order = np.argsort(often | (own >> np.uint64(32)), kind="stable")[:size]
                    prefix.append(own[order].view(np.int64))
                    cold.append(int(np.searchsorted(often[order] >> np.uint64(32), hot, side="right")))
                flags = np.array(parity, np.int64).reshape(-1, words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int32()), pa.array(key, pa.int64()), *[pa.array(flags[:, k]) for k in range(words)], pa.array(prefix, pa.list_(pa.int64())), pa.array(cold, pa.int32())],
                    names=["id", "n", "cls", *names, "prefix", "n_cold"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"id {kind}, n int, cls bigint, {', '.join(f'{c} bigint' for c in names)}, prefix array<bigint>, n_cold int")


def class_bits(needed: DataFrame) -> list[bytes]:
    """One bit per cell of ``CLASS_BITS`` in ``_PARTS`` compressed parts; the cells of needed classes are set."""
    size = CLASS_BITS // _PARTS

    def mark(group: pa.Table) -> pa.Table:
        flags = np.zeros(size, dtype=bool)
        flags[group.column("bit").to_numpy() % size] = True
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "blob": pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())})

    bit = F.pmod("cls", F.lit(CLASS_BITS)).cast("bigint")
    cells = needed.select(bit.alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / size).cast("int"))
    parts = cells.groupBy("part").applyInArrow(mark, "part int, blob binary").collect()
    found = {r["part"]: bytes(r["blob"]) for r in parts}
    return [found.get(k, zlib.compress(bytes(size // 8), 1)) for k in range(_PARTS)]


def _sets(rows: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """``cls, shingles`` of the needed classes, each once, and of a few others in the same cells."""
    shared, cells = rows.sparkSession.sparkContext.broadcast(class_bits(needed)), CLASS_BITS

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(b"".join(zlib.decompress(x) for x in shared.value), dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                keys, sets = [], []
                for own in shingle_rows(part.column("text"), width):
                    if not len(own):
                        continue
                    key = set_key(own)
                    cell = key % cells
                    if bits[cell >> 3] >> (7 - (cell & 7)) & 1 and key not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(key)
                        keys.append(key), sets.append(own.view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "shingles"])

    return rows.select("text").mapInArrow(collect, "cls bigint, shingles array<bigint>").dropDuplicates(["cls"])


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _near(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Length and positional filter on two entries of the same shingle; null where one is missing."""
    both = nx.cast("bigint") + ny
    length = (100 * F.least(nx, ny).cast("bigint")) >= (percent * F.greatest(nx, ny).cast("bigint"))
    position = (F.least(nx - px, ny - py).cast("bigint") * (100 + percent)) >= (percent * both)
    return length & position


def _most_apart(nx: Column, ny: Column, percent: int) -> Column:
    """Shingles that at most may be in only one of two sets of these sizes."""
    both = nx.cast("bigint") + ny
    return both - 2 * F.ceil((percent * both).cast("double") / (100 + percent) - F.lit(1e-9))


def _may_match(percent: int) -> Column:
    """Length, positional and suffix filters on two entries ``x.`` and ``y.`` of the same shingle.

    This part of the suffix filter counts the shingles before the common one that are in no other prefix
    (``own``): were one in the other set, it would come before the common one there too and be in its
    prefix. More than the threshold allows rule the pair out.
    """
    nx, ny = F.col("x.n"), F.col("y.n")
    near = _near(nx, F.col("x.pos"), ny, F.col("y.pos"), percent)
    return near & ((F.col("x.own") + F.col("y.own")) <= _most_apart(nx, ny, percent))


def _few_differ(percent: int) -> Column:
    """The other part of the suffix filter: cells of different parity each stand for a shingle of one set only."""
    differ = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITY_BITS // 64)), F.lit(0))
    return differ <= _most_apart(F.col("x.n"), F.col("y.n"), percent)


def _shared_entries(signed: DataFrame, percent: int) -> DataFrame:
    """``tok, cls, n, pos, near`` of prefix shingles that at least two classes hold, each class once.

    ``near`` tells whether another entry may match: in groups of up to four by the filters themselves,
    in larger ones by the lengths next to it. Shingles of hot cells are passed on unseen: only they can
    have more entries than the threshold of their cell, so no window is larger than that.
    """
    entries = signed.where(F.col("prefix").isNotNull()).select("cls", "n", "n_cold", F.posexplode("prefix").alias("pos", "tok"))
    whole, by_length = Window.partitionBy("tok"), Window.partitionBy("tok").orderBy("n", "cls")
    cold = entries.where("pos < n_cold").select("tok", "cls", "n", "pos").withColumn("last", F.lag("cls").over(by_length))
    cold = cold.where("last is null or last <> cls").drop("last").withColumn("size", F.count("*").over(whole)).where("size > 1")
    steps = [(k, f(c, k).over(by_length)) for k in (1, 2, 3) for c in ("n", "pos") for f in (F.lag, F.lead)]
    names = [f"{f}_{c}_{k}" for k in (1, 2, 3) for c in ("n", "pos") for f in ("lag", "lead")]
    cold = cold.select("*", *[e.alias(n) for (_, e), n in zip(steps, names)])
    exact, by_size = F.lit(False), F.lit(False)
    for side in ("lag", "lead"):
        for k in (1, 2, 3):
            exact = exact | F.coalesce(_near(F.col("n"), F.col("pos"), F.col(f"{side}_n_{k}"), F.col(f"{side}_pos_{k}"), percent), F.lit(False))
        other = F.col(f"{side}_n_1")
        by_size = by_size | F.coalesce(100 * F.least("n", other).cast("bigint") >= percent * F.greatest("n", other).cast("bigint"), F.lit(False))
    cold = cold.select("tok", "cls", "n", "pos", F.when(F.col("size") <= 4, exact).otherwise(by_size).alias("near"))
    hot = entries.where("pos >= n_cold").select("tok", "cls", "n", "pos", F.lit(True).alias("near")).dropDuplicates(["tok", "cls"])
    return cold.unionByName(hot)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold, each compared once."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    compared = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    union = F.size("sa") + F.size("sb") - common
    return compared.where(100 * common >= percent * union).select("a", "b")


def link_documents(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by shingle sets of at least ``percent`` Jaccard similarity.

    Equal sets are one class, so copies cost one entry per task. Classes share the entries of their
    rare-first prefixes. Per shingle and length band, each class is first compared with a few heads; what
    that links is one component, and only classes of different components are then compared among
    themselves, so a large group of near copies is not expanded into pairs. All candidates pass the
    length, positional and suffix filters and are verified once on the whole sets.

    Words are runs without ASCII white space, A-Z lower-cased. Texts with fewer than ``width`` words
    are one shingle. Null texts and texts without words have no shingles, link with nothing and keep
    their own id. Rows with the same id or without one are separate documents of their class; the least
    id of a component skips nulls. Shingles and classes are 64-bit hashes. Extra columns are ignored.

    Returns per row ``id_col, n_shingles, component_id``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parity = [f"p{k}" for k in range(PARITY_BITS // 64)]
    signed = stored(_signatures(rows, cell_counts(rows, width), percent, width), "signatures")

    facts = signed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in ("n", *parity)])
    facts = stored(facts, "classes")
    earlier = F.row_number().over(Window.partitionBy("cls").orderBy("pos")) - 1
    shared = _shared_entries(signed, percent).withColumn("own", F.col("pos") - earlier)
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)))
    kept = stored(shared.where("near").drop("near").withColumn("band", band), "entries")

    # Heads lie in the shorter prefix that an equally long partner needs; the one with the fewest
    # shingles of its own is closest to what the others were copied from.
    fact = F.struct("cls", "n", "pos", "own")
    first = [F.min_by(fact, F.struct(F.col("own"), F.xxhash64("cls"))), *[F.min_by(fact, F.xxhash64("cls", F.lit(k))) for k in range(1, HEADS)]]
    early = (F.col("n") - F.col("pos")).cast("bigint") * (100 + percent) >= 2 * percent * F.col("n").cast("bigint")
    heads = kept.where(early).groupBy("tok", "band").agg(F.explode(F.array_distinct(F.array(*first))).alias("head")).select("tok", "band", "head.*")
    pair = [F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")]
    same_band = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.cls") != F.col("y.cls"))
    tried = kept.alias("x").join(heads.alias("y"), same_band & _may_match(percent)).select(*pair).distinct()
    marks = facts.select("cls", "n", *parity)
    tried = tried.join(marks.alias("x"), F.col("a") == F.col("x.cls")).join(marks.alias("y"), F.col("b") == F.col("y.cls"))
    tried = stored(tried.where(_few_differ(percent)).select("a", "b"), "pairs")
    links = stored(_verified(tried, _sets(rows, _members(tried), width), percent), "links")

    labels = components(links)
    labelled = kept.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = labelled.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    labelled = labelled.drop("band").join(facts.select("cls", *parity), "cls")
    labelled = stored(labelled.join(mixed, "tok", "left_semi"), "open")
    apart = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
    rest = labelled.alias("x").join(labelled.alias("y"), apart & _may_match(percent) & _few_differ(percent)).select(*pair).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = stored(links.unionByName(_verified(rest, _sets(rows, _members(rest), width), percent)), "links")

    roots = components(links).withColumnRenamed("node", "cls")
    found = facts.select("cls", "low").join(roots, "cls", "left")
    least = found.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    found = found.join(least, "root", "left").select("cls", F.coalesce("least", "low").alias("component"))
    out = signed.select("id", "n", "cls").join(found, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
