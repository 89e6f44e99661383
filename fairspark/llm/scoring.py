"""Text scores: smoothed unigrams and a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm import ragged
from fairspark.llm.tables import stored

#: Words with their counts on every executor; all others are joined by shuffle.
LEXICON = 131_072
#: Words with vectors of their own. One more class holds all others, one the end of a text.
VOCABULARY = 1_024
DIMENSION = 48
NOISE_RATIO = 20.0
STEPS = 200
#: Weight of the pull of vectors towards zero, in counted pairs; few pairs per class then stay near the unigrams.
DECAY = 4.0
RATE = 0.05
#: Bytes of text that a task turns into arrays at a time; its arrays take some twenty times that.
SLICE_BYTES = 4 << 20
#: The end of a text, written as a character that no word contains.
END = "\n"


@dataclass
class LogBilinear:
    """Score of class w after class a: ``(r[a] @ c) . q[w] + b[w]``, normalised over the classes."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probability of each class after each class: one product of matrices."""
        s = (self.r @ self.c) @ self.q.T + self.b
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return s / math.log(10)


def train(pairs: np.ndarray, dimension: int = DIMENSION, noise_ratio: float = NOISE_RATIO, steps: int = STEPS, seed: int = 11) -> LogBilinear:
    """Fit to counts ``pairs[a, w]`` of class w after class a.

    The objective is that of noise-contrastive estimation: tell each observed pair from
    ``noise_ratio`` draws of a noise word. As all pairs are counted and the vocabulary is closed, the
    expectation over the noise (the smoothed unigram distribution) is taken exactly instead of by
    sampling. Adam over whole-matrix gradients.
    """
    n = len(pairs)
    rng = np.random.default_rng(seed)
    total = max(pairs.sum(), 1.0)
    noise = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + n)
    seen = pairs / total
    drawn = noise_ratio * (pairs.sum(axis=1) / total)[:, None] * noise[None, :]
    shift = np.log(noise_ratio * noise)
    values = {
        "r": rng.normal(0, 0.1, (n, dimension)),
        "c": np.eye(dimension),
        "q": rng.normal(0, 0.1, (n, dimension)),
        "b": np.log(noise),
    }
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    for step in range(1, steps + 1):
        r, c, q, b = values["r"], values["c"], values["q"], values["b"]
        h = r @ c
        real = 1.0 / (1.0 + np.exp(-np.clip(h @ q.T + b - shift, -50, 50)))
        slope = seen * (1.0 - real) - drawn * real
        dh = slope @ q
        gradient = {"r": dh @ c.T, "c": r.T @ dh, "q": slope.T @ h, "b": slope.sum(axis=0)}
        for k in ("r", "q"):
            gradient[k] -= DECAY / total * values[k]
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in gradient.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            values[k] = values[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return LogBilinear(**values)


@dataclass
class Scorer:
    """What a task needs: the lexicon with counts, its classes and the normalised tables."""

    lexicon: pa.Array  # words in order of frequency, the first ones with classes 0, 1, ...
    counts: np.ndarray
    n_classes: int  # words with a class; then the class of all others, then the end
    table: np.ndarray | None
    tokens: int  # N
    types: int  # V
    end_count: int
    rest_tokens: int
    rest_types: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.types + 1.0))

    def classes(self, found: ragged.Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon index (-1: not in it) and class of each distinct word."""
        at = pc.index_in(found.values, value_set=self.lexicon).fill_null(-1).to_numpy(zero_copy_only=False)
        return at, np.where((at >= 0) & (at < self.n_classes), at, self.n_classes)

    def streams(self, found: ragged.Pieces, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, class before and class of every token, with the end after each row's words."""
        words = np.bincount(found.row, minlength=found.n_rows)
        ends = np.cumsum(words + 1) - 1
        row = np.repeat(np.arange(found.n_rows), words + 1)
        own = np.full(len(row), self.n_classes + 1, dtype=np.int32)
        inner = np.ones(len(row), dtype=bool)
        inner[ends] = False
        own[inner] = label[found.code]
        before = np.append(np.int32(self.n_classes + 1), own[:-1])[: len(own)]
        return row, before, own


def _word_counts(train_rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                found = ragged.words(part.column("text"))
                n = np.bincount(found.code, minlength=len(found.values))
                used = np.flatnonzero(n)
                word = pa.concat_arrays([found.values.take(pa.array(used)).cast(pa.large_string()), pa.array([END], pa.large_string())])
                yield pa.RecordBatch.from_arrays([word.cast(pa.string()), pa.array(np.append(n[used], part.num_rows).astype(np.int64))], names=["word", "c"])

    return train_rows.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _pair_counts(train_rows: DataFrame, scorer) -> DataFrame:
    """Counts of neighbouring classes: each task adds up its texts, then cells are summed by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scorer.value
        width = known.n_classes + 2
        cells = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                found = ragged.words(part.column("text"))
                _, before, own = known.streams(found, known.classes(found)[1])
                cells += np.bincount(before.astype(np.int64) * width + own, minlength=width * width)
        used = np.flatnonzero(cells)
        for lo in range(0, len(used), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[lo : lo + 100_000]), pa.array(cells[used[lo : lo + 100_000]])], names=["cell", "n"])

    return train_rows.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram and log-bilinear log10 probabilities of every whole text.

    Words are runs without ASCII white space, A-Z lower-cased; one end token closes each text. The
    model learns from all rows where ``held_out`` is false: every training token is counted, as a word
    and as a pair of neighbouring classes. Classes are the ``VOCABULARY`` most frequent words, one for
    all other words and the end. A word of the remaining class is scored by that class and its add-one
    share of it, so the probabilities of all words, unseen ones together, sum to one.

    The lexicon, the matrix of class pairs and the model have fixed greatest sizes; counts of words
    outside the lexicon stay on the executors and are joined by shuffle.

    Null and empty texts are the end token alone. Repeated rows are scored and counted each; null ids
    are kept; extra columns are ignored. Without training rows every word is unknown and the model is
    uniform over its classes.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held")).select("text")

    counts = stored(_word_counts(training), "words")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, types = int(sums["n"] or 0), int(sums["v"])
    ends = counts.where(F.col("word") == END).first()
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(LEXICON).toPandas()
    n_classes = min(VOCABULARY, len(top))
    frequent = top["c"].to_numpy().astype(np.int64)
    end_count = int(ends["c"]) if ends else 0
    scorer = Scorer(
        lexicon=pa.array([w.encode() for w in top["word"]], pa.large_binary()),
        counts=frequent,
        n_classes=n_classes,
        table=None,
        tokens=tokens,
        types=types,
        end_count=end_count,
        rest_tokens=tokens - end_count - int(frequent[:n_classes].sum()),
        rest_types=types - n_classes - (1 if ends else 0),
    )
    context = spark.sparkContext
    width = n_classes + 2
    cells = _pair_counts(training, context.broadcast(scorer)).toPandas()
    pairs = np.zeros(width * width)
    pairs[cells["cell"].to_numpy().astype(np.int64)] = cells["n"].to_numpy()
    scorer.table = train(pairs.reshape(width, width)).log10_table().astype(np.float64)
    shared = context.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lexicon_base = known.base(known.counts)
        share = math.log10(known.rest_tokens + known.rest_types + 1.0)
        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                found = ragged.words(part.column("text"))
                at, label = known.classes(found)
                row, before, own = known.streams(found, label)
                inside = at >= 0
                base = np.where(inside, lexicon_base[np.maximum(at, 0)], 0.0) if len(known.counts) else np.zeros(len(at))
                within = np.where(inside & (label == known.n_classes), np.log10(known.counts[np.maximum(at, 0)] + 1.0) - share, 0.0) if len(known.counts) else base
                n = np.bincount(row, minlength=part.num_rows)
                score = np.bincount(row, weights=known.table[before, own], minlength=part.num_rows) + found.per_row(within)
                base = found.per_row(base) + float(known.base(np.array(known.end_count)))
                n_known = found.per_row(inside.astype(np.float64)).astype(np.int64) + (known.end_count > 0)
                # Words outside the lexicon, once per row with their number.
                outside = np.flatnonzero(~inside[found.code]) if len(found) else np.zeros(0, np.int64)
                keys, times = np.unique(found.row[outside].astype(np.int64) * max(len(at), 1) + found.code[outside], return_counts=True)
                rest_row, rest_code = keys // max(len(at), 1), keys % max(len(at), 1)
                offsets = pa.array(np.searchsorted(rest_row, np.arange(part.num_rows + 1)), pa.int32())
                rare = found.values.take(pa.array(rest_code)).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("held"),
                        pa.array(n.astype(np.int64)),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(offsets, rare),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    ],
                    names=["id", "held", "n_tokens", "n_known", "base", "score", "rare", "times"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    first = rows.mapInArrow(run, f"id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<string>, times array<bigint>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    count = F.coalesce(F.col("c"), F.lit(0))
    spread = F.lit(float(tokens + types + 1))
    share = F.lit(float(scorer.rest_tokens + scorer.rest_types + 1))
    added = rare.join(counts, "word", "left").select(
        "row",
        F.when(count > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"),
        (F.col("n") * F.log10((count + 1.0) / spread)).alias("base"),
        (F.col("n") * F.log10((count + 1.0) / share)).alias("score"),
    )
    sums = added.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("n_known", "base", "score")])
    joined = first.drop("rare", "times").join(sums, "row", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        plus("n_known").cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        plus("base").alias("base_score"),
        plus("score").alias("score"),
    )
