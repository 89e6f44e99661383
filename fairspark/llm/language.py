"""Language identification by known words, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.llm import ragged
from fairspark.llm.tables import stored

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)  # n-gram lengths, tried in this order
#: Rows per language that the model is fitted on, chosen by hash; rarer languages keep all their rows.
FIT_ROWS = 5_000
#: Entries of the fitted tables, parameters of the fit. Less frequent words and n-grams back off like unseen ones.
MOST_WORDS = 100_000
MOST_GRAMS = 50_000  # of each length
SMOOTHING = 0.5


@dataclass
class LanguageModel:
    """Per level (0: words, n: n-grams) sorted hashes and one row of log frequencies by language."""

    languages: list[str]
    hashes: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]

    def known(self, level: int, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.hashes[level]
        if not len(keys):
            return np.zeros(len(hashed), bool), np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return keys[at] == hashed, at

    def word_scores(self, values: pa.Array) -> np.ndarray:
        """One row per distinct word: its log frequency, or the mean over its longest known n-grams."""
        out = np.zeros((len(values), len(self.languages)), dtype=np.float64)
        if not len(values):
            return out
        hit, at = self.known(0, ragged.hash64(values))
        out[hit] = self.scores[0][at[hit]] if hit.any() else 0
        open_words = np.flatnonzero(~hit)
        points, offsets = _points(values)
        for n in ORDERS:
            if not len(open_words):
                break
            grams, word = _grams(points, offsets, open_words, n)
            hit, at = self.known(n, grams)
            word, at = word[hit], at[hit]
            found = np.bincount(word, minlength=len(values))
            for k in range(len(self.languages)):
                total = np.bincount(word, weights=self.scores[n][at, k], minlength=len(values))
                out[:, k] += np.where(found > 0, total / np.maximum(found, 1), 0)
            open_words = open_words[found[open_words] == 0]
        return out


def _points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word between two marks, and their offsets."""
    data, at = ragged.flat(values)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    heads = np.append(0, np.cumsum(~ragged.IS_TAIL[data]))[at]
    lengths = np.diff(heads)
    offsets = heads + 2 * np.arange(len(heads))
    out = np.full(int(offsets[-1]), 3, dtype=np.uint64)
    out[offsets[:-1]] = 2
    out[ragged.gather(offsets[:-1] + 1, lengths)] = points
    return out, offsets


def _grams(points: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the chosen words, and the word of each."""
    lengths = np.diff(offsets)[chosen]
    marks = 1 if n == 1 else 0  # a mark alone says nothing
    room = np.maximum(lengths - n + 1 - 2 * marks, 0)
    start = ragged.gather(offsets[:-1][chosen] + marks, room)
    weight = ragged.powers(n + 1)
    total = np.full(len(start), n, dtype=np.uint64)
    for k in range(n):
        total += points[start + k] * weight[k + 1]
    return ragged.finish(total), np.repeat(chosen, room)


def _words(column: pa.Array) -> ragged.Pieces:
    return ragged.words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))


def fit(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    order: Column | None = None,
    fit_rows: int = FIT_ROWS,
    most_words: int = MOST_WORDS,
    most_grams: int = MOST_GRAMS,
) -> LanguageModel:
    """Log frequencies of words and n-grams from about ``fit_rows`` rows of each language.

    Rows are taken where a hash of ``order`` falls below the language's share, so the sample is the
    same in every run. Words and n-grams are counted on the executors and written; the driver receives the
    ``most_words`` most frequent words and ``most_grams`` n-grams of each length, a bounded table.

    Rows without a language or text teach nothing, empty texts only that their language occurs; repeated
    rows count each. Ties at the bounds go to the smaller hash. An empty table gives an empty model.
    """
    draw = F.pmod(F.xxhash64(order if order is not None else F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        empty = {n: np.zeros(0, np.uint64) for n in (0, *ORDERS)}
        return LanguageModel([], empty, {n: np.zeros((0, 0)) for n in empty})
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(fit_rows / sizes[k]))])
    sample = rows.where(F.col("draw") < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text", 4 * ragged.SLICE_BYTES):
                for lang in pc.unique(part.column("lang")).to_pylist():
                    own = part.column("text").filter(pc.equal(part.column("lang"), lang))
                    found = _words(own)
                    times = np.bincount(found.code, minlength=len(found.values))
                    used = np.flatnonzero(times)
                    points, offsets = _points(found.values)
                    for level in (0, *ORDERS):
                        if level:
                            grams, word = _grams(points, offsets, used, level)
                            weight = times[word]
                        else:
                            grams, weight = ragged.hash64(found.values)[used], times[used]
                        keys, inverse = np.unique(grams, return_inverse=True)
                        n = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                            names=["lang", "level", "gram", "n"],
                        )

    counted = sample.mapInArrow(count, "lang string, level int, gram bigint, n bigint").groupBy("level", "gram").pivot("lang", languages).agg(F.sum("n"))
    counted = counted.na.fill(0).withColumn("total", sum((F.col(f"`{k}`") for k in languages), F.lit(0)))
    counted = stored(counted, "counts")
    hashes, scores = {}, {}
    for level in (0, *ORDERS):
        most = most_grams if level else most_words
        top = counted.where(F.col("level") == level).orderBy(F.desc("total"), "gram").limit(most).toPandas()
        keys = top["gram"].to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        n = top[languages].to_numpy().astype(np.float64)[by].reshape(len(keys), len(languages))
        hashes[level] = keys[by]
        scores[level] = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * (len(keys) + 1))) if len(keys) else n
    return LanguageModel(languages, hashes, scores)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Most likely language of every whole text, and its posterior probability.

    Each distinct word of a slice is scored once; a text sums its words. No shuffle; the model is a
    broadcast of bounded size.

    Null texts, texts without a letter and an empty model give ``und`` with score 0. Ties go to the
    first language by name. Repeated rows and null ids are kept row by row; extra columns are ignored.

    Returns ``id_col``, the columns of ``carry``, ``lang_pred, score``.
    """
    carry = carry or {}
    extra = [e.alias(f"c_{k}") for k, e in carry.items()]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["id", *[f"c_{k}" for k in carry]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = np.array([*fitted.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                text = part.column("text")
                found = _words(text)
                n = len(fitted.languages)
                label, score = np.full(part.num_rows, n), np.zeros(part.num_rows)
                if n:
                    per_word = fitted.word_scores(found.values)
                    total = np.stack([found.per_row(per_word[:, k]) for k in range(n)], axis=1)
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                    label = np.where(lettered, total.argmax(axis=1), n)
                    score = np.where(lettered, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in kept], pa.array(names[label], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), *[F.col(f"c_{k}").alias(k) for k in carry], "lang_pred", "score")
