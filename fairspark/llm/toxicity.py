"""Toxicity by nearest labelled examples: exact cosine over all terms, by a block-max inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.llm import ragged
from fairspark.llm.decontamination import tokens
from fairspark.llm.tables import stored

#: Labelled rows that the index is fitted on, about; chosen by a hash of the id.
FIT_ROWS = 20_000
#: Most frequent terms, whose weights are also kept as a matrix; which ones these are changes no result.
DENSE_TERMS = 320
#: Texts whose neighbours are searched together.
BATCH = 64
#: Examples, at even steps, whose votes without themselves calibrate the score.
CALIBRATION_ROWS = 4_000
#: More than single precision can err in the product of two unit vectors.
MARGIN = 1e-4
NEIGHBOURS = 15
BLOCK = 64
#: Weight of the base rate among the votes.
PRIOR_WEIGHT = 0.5


@dataclass
class ExampleIndex:
    """Examples as unit vectors in posting lists by term; each list of a frequent term carries its maximum per block."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # times the relevance frequency
    first: np.ndarray  # postings of term t: first[t] to first[t + 1], ascending by example
    example: np.ndarray
    weight: np.ndarray
    block_first: np.ndarray  # block entries of term t
    block: np.ndarray
    block_most: np.ndarray
    block_posting: np.ndarray  # first posting of the block entry, one more at the end
    toxic: np.ndarray
    ids: list
    n_blocks: int
    base_rate: float  # of all examples
    empty_score: float  # of examples without any term
    slope: float = 1.0
    shift: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def vector(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index terms of a text and their weights, scaled to length 1."""
        if not len(self.terms) or not len(hashed):
            return np.zeros(0, np.int64), np.zeros(0)
        own, times = np.unique(hashed, return_counts=True)
        at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        known = self.terms[at] == own
        found = at[known]
        weight = (1.0 + np.log(times[known])) * self.idf[found]
        return found, weight / max(math.sqrt(float(weight @ weight)), 1e-300)

    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column of each term or -1, weights of the frequent terms by example in both precisions, their maxima by block."""
        if "_dense" not in self.__dict__:
            common = _frequent(np.diff(self.first))
            column = np.full(len(self.terms), -1, dtype=np.int64)
            column[common] = np.arange(len(common))
            exact, most = np.zeros((self.n_blocks * BLOCK, len(common))), np.zeros((self.n_blocks, len(common)), np.float32)
            size = self.first[common + 1] - self.first[common]
            posting = ragged.gather(self.first[common], size)
            exact[self.example[posting], np.repeat(np.arange(len(common)), size)] = self.weight[posting]
            size = self.block_first[common + 1] - self.block_first[common]
            entry = ragged.gather(self.block_first[common], size)
            most[self.block[entry], np.repeat(np.arange(len(common)), size)] = self.block_most[entry]
            self._dense = column, exact, exact.astype(np.float32), most
        return self._dense

    def nearest_many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ``k`` examples of greatest cosine for each vector, exactly; equal ones by position.

        Postings of the rarer terms are added up first, which bounds the k-th best cosine from below;
        blocks that cannot reach that with the block maxima of the frequent terms are left out. For all others
        the frequent terms are a product in single precision, and what that leaves in reach of the k-th best
        is computed again in double precision.
        """
        column, exact, single, most = self.dense()
        n = self.n_blocks * BLOCK
        query, part = np.zeros((len(vectors), exact.shape[1])), np.zeros((len(vectors), n))
        for i, (found, weight) in enumerate(vectors):
            at = column[found]
            query[i, at[at >= 0]] = weight[at >= 0]
            rare = found[at < 0]
            lo, hi = self.first[rare], self.first[rare + 1]
            if len(rare):
                lists = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist())]
                product = np.repeat(weight[at < 0], hi - lo)
                product *= np.concatenate([self.weight[x] for x in lists])
                part[i] = np.bincount(np.concatenate([self.example[x] for x in lists]), weights=product, minlength=n)
            if skip is not None:
                part[i, skip[i]] = -2.0
        # The k-th best block maximum is at most the k-th best sum.
        tops = part.reshape(len(vectors), self.n_blocks, BLOCK).max(axis=2)
        bound = tops + query.astype(np.float32) @ most.T + MARGIN
        visited = np.flatnonzero((bound >= _kth(tops, k)[:, None]).any(axis=0))
        rows = slice(None) if len(visited) == self.n_blocks else ragged.gather(visited * BLOCK, np.full(len(visited), BLOCK))
        near = query.astype(np.float32) @ single[rows].T
        near += part[:, rows]
        reach = _kth(near.reshape(len(vectors), len(visited), BLOCK).max(axis=2), k) - 2 * MARGIN
        out = []
        for i in range(len(vectors)):
            best = np.flatnonzero(near[i] >= max(reach[i], -1.0))
            best = best if isinstance(rows, slice) else rows[best]
            # Row sums, unlike a product of matrices, are the same wherever the row stands.
            cosine = part[i, best] + (exact[best] * query[i]).sum(axis=1)
            best, cosine = best[cosine > 0], cosine[cosine > 0]
            keep = np.lexsort((best, -np.round(cosine, 12)))[:k]
            out.append((best[keep], cosine[keep]))
        return out

    def nearest(self, found: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(found, weight)], k)[0]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by its cosine, drawn to the base rate."""
        return float((cosine @ self.toxic[best] + PRIOR_WEIGHT * self.base_rate) / (cosine.sum() + PRIOR_WEIGHT))

    def calibrated(self, vote: float) -> float:
        odds = math.log(vote / (1.0 - vote)) if 0.0 < vote < 1.0 else math.copysign(30.0, vote - 0.5)
        return 1.0 / (1.0 + math.exp(-min(max(self.slope * odds + self.shift, -30.0), 30.0)))

    def scores(self, hashed: list[np.ndarray]) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """Position, score and neighbours of every text that has an index term."""
        vectors = [self.vector(h) for h in hashed]
        known = [i for i, (found, _) in enumerate(vectors) if len(found)]
        for lo in range(0, len(known), BATCH):
            own = known[lo : lo + BATCH]
            for i, (best, cosine) in zip(own, self.nearest_many([vectors[i] for i in own])):
                yield i, self.calibrated(self.vote(best, cosine)), best, cosine


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, 0 in shorter rows."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.zeros(len(values))


def _frequent(df: np.ndarray) -> np.ndarray:
    return np.sort(np.argsort(-df, kind="stable")[:DENSE_TERMS])


def _calibrate(index: ExampleIndex, vectors: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray) -> None:
    """Logistic fit of the label to the log odds of votes that leave the example itself out."""
    odds, label = [], index.toxic[chosen]
    for lo in range(0, len(chosen), BATCH):
        for best, cosine in index.nearest_many(vectors[lo : lo + BATCH], skip=chosen[lo : lo + BATCH].tolist()):
            v = index.vote(best, cosine)
            odds.append(math.log(v / (1 - v)) if 0 < v < 1 else math.copysign(30.0, v - 0.5))
    x, y = np.array(odds), label
    if len(x) < 20 or y.min() == y.max() or x.std() < 1e-9:
        return
    design = np.stack([x, np.ones(len(x))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ theta, -30, 30)))
        # Pulled towards (1, 0), so that separable votes keep finite odds.
        gradient = design.T @ (y - p) - (theta - np.array([1.0, 0.0]))
        theta = theta + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), gradient)
    if theta[0] > 0:
        index.slope, index.shift = float(theta[0]), float(theta[1])


def _terms(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Distinct tokens of each text as bytes of 64-bit hashes, with their numbers as bytes of 32-bit ones."""
    kept = ["id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                flat, at = tokens(part.column("text"))
                found, times = [], []
                for a, b in zip(at[:-1], at[1:]):
                    own, n = np.unique(flat[a:b], return_counts=True)
                    found.append(own.tobytes()), times.append(n.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(found, pa.binary()), pa.array(times, pa.binary())], names=[*kept, "term", "times"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return rows.mapInArrow(run, f"{kinds}, term binary, times binary")


def build_index(ids: list, toxic: np.ndarray, sizes: np.ndarray, hashed: np.ndarray, times: np.ndarray) -> ExampleIndex:
    """Index over examples given by their label and ``sizes`` distinct terms each, with their numbers.

    Every term counts: its weight is the inverse document frequency times the relevance frequency,
    log2(2 + toxic examples / clean examples with the term), at least 1 for any term.
    """
    n1 = int(toxic.sum())
    base = (n1 + 0.5) / (len(toxic) + 1.0)
    some = sizes > 0
    empty, empty_toxic = int((~some).sum()), int(toxic[~some].sum())
    ids, toxic, sizes = [i for i, s in zip(ids, some.tolist()) if s], toxic[some].astype(np.float64), sizes[some]
    terms, term = np.unique(hashed, return_inverse=True)
    term = term.astype(np.int32)
    example = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    df = np.bincount(term, minlength=len(terms))
    df1 = np.bincount(term, weights=toxic[example], minlength=len(terms))
    idf = np.log(1.0 + len(some) / np.maximum(df, 1)) * np.log2(2.0 + df1 / np.maximum(df - df1, 1.0))
    weight = (1.0 + np.log(times)) * idf[term]
    weight /= np.sqrt(np.bincount(example, weights=weight * weight, minlength=len(ids)))[example]
    # Even steps through the examples, as the postings still stand by example.
    chosen = np.unique(np.linspace(0, len(ids) - 1, min(len(ids), CALIBRATION_ROWS)).astype(np.int64)) if ids else np.zeros(0, np.int64)
    start = np.cumsum(sizes) - sizes
    vectors = [(term[a : a + s].copy(), weight[a : a + s].copy()) for a, s in zip(start[chosen].tolist(), sizes[chosen].tolist())]

    order = np.argsort(term, kind="stable")
    term, weight, example = term[order], weight[order], example[order]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    common = _frequent(df)
    posting = ragged.gather(first[common], df[common])
    owner, block = term[posting], example[posting] // BLOCK
    new = np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])) if len(posting) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    index = ExampleIndex(
        terms=terms,
        idf=idf,
        first=first,
        example=example,
        weight=weight,
        block_first=np.searchsorted(owner[starts], np.arange(len(terms) + 1)),
        block=block[starts],
        block_most=np.maximum.reduceat(weight[posting], starts) if len(starts) else np.zeros(0),
        block_posting=np.append(posting[starts], len(term)),
        toxic=toxic,
        ids=ids,
        n_blocks=len(ids) // BLOCK + 1,
        base_rate=base,
        empty_score=(empty_toxic + base) / (empty + 1.0),
    )
    _calibrate(index, vectors, chosen)
    index.__dict__.pop("_dense", None)
    return index


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ExampleIndex:
    """Index over about ``fit_rows`` labelled documents, chosen by a hash of the id.

    Terms are cut and counted on the executors. The driver receives the distinct terms of the sample's
    texts, which ``fit_rows`` bounds, and indexes all of them for toxic and clean examples alike. Rows
    without an id or a label are left out; an id labelled both ways counts as toxic; repeated rows are
    an example each.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = fit_rows / max(marked.count(), 1)
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # One partition at a time; ordered by the terms too, so that positions do not depend on the order of arrival.
    held = sorted((r["id"], bytes(r["term"]), bytes(r["times"]), r["toxic"]) for r in stored(_terms(rows, ["toxic"]), "examples").toLocalIterator())
    ids, toxic = [r[0] for r in held], np.array([r[3] != 0 for r in held], dtype=bool)
    sizes = np.array([len(r[1]) // 8 for r in held], dtype=np.int64)
    hashed, times = np.frombuffer(b"".join(r[1] for r in held), np.uint64), np.frombuffer(b"".join(r[2] for r in held), np.int32)
    del held
    return build_index(ids, toxic, sizes, hashed, times)


def score_documents(docs: DataFrame, index: ExampleIndex, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Calibrated toxicity of every whole text, with the examples that voted for it.

    Only the fitted index is broadcast; its size is bounded by the sample. No shuffle. A text without
    any term of the examples gets the rate of toxic examples without terms; so do null and empty texts. Without
    examples the score is 0.5 drawn to nothing, so fit on labelled rows. Repeated rows and null ids
    are kept row by row; extra columns are ignored.

    Returns ``id_col``, the columns of ``carry``, ``score, predicted, neighbours`` (example id, cosine,
    label).
    """
    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[e.alias(f"c_{k}") for k, e in carry.items()])
    kept = ["id", *[f"c_{k}" for k in carry]]
    shared = docs.sparkSession.sparkContext.broadcast(index)
    evidence = "array<struct<id:bigint,cosine:double,toxic:int>>"
    evidence_kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    if index.ids and not isinstance(index.ids[0], int):
        evidence = evidence.replace("bigint", "string")
        evidence_kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        text_ids = evidence_kind.value_type.field(0).type == pa.string()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                flat, at = tokens(part.column("text"))
                score = np.full(part.num_rows, fitted.empty_score)
                voters: list = [[] for _ in range(part.num_rows)]
                for i, score[i], best, cosine in fitted.scores([flat[a:b] for a, b in zip(at[:-1], at[1:])]):
                    voters[i] = [
                        {"id": str(fitted.ids[e]) if text_ids else fitted.ids[e], "cosine": c, "toxic": int(fitted.toxic[e])}
                        for e, c in zip(best.tolist(), cosine.tolist())
                    ]
                predicted = pa.array((score >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(score), predicted, pa.array(voters, evidence_kind)], names=[*kept, "score", "predicted", "neighbours"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    out = rows.mapInArrow(run, f"{kinds}, score double, predicted int, neighbours {evidence}")
    return out.select(F.col("id").alias(id_col), *[F.col(f"c_{k}").alias(k) for k in carry], "score", "predicted", "neighbours")
