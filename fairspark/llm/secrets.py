"""Secrets in texts: fixed patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairspark.functions.ordering import running_sums
from fairspark.llm import ragged
from fairspark.llm.tables import stored

KINDS = ("assign", "access", "hex", "model")
_ASSIGN_HEAD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]"
#: Pattern, group that is measured and its least length.
BASE = {
    "assign": (re.compile(_ASSIGN_HEAD + r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: What a text with a base match must hold.
_HINT = _ASSIGN_HEAD + "|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: Characters of a candidate run, and its least length.
_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAST_RUN = 12
#: Characters of context before and after a candidate.
BEFORE, AFTER = 24, 12
#: Findings that one task of the fit trains on, passes over all of them, and planted keys: per other candidate, and least.
SHARD_FINDINGS = 4_096
EPOCHS = 6
PLANTED_EACH, LEAST_PLANTED = 2, 600
#: Least recall on held-out findings of each family of candidates.
RECALL = 0.98

#: Prefix, alphabet and length of published key formats, for findings planted into real contexts.
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_BASE64 = _ALNUM + "+/"
_URL64 = _ALNUM + "-_"
FORMATS = [
    ("ghp_", _ALNUM, 36),
    ("github_pat_", _ALNUM + "_", 60),
    ("glpat-", _URL64, 20),
    ("sk_live_", _ALNUM, 24),
    ("xoxb-", "0123456789-", 24),
    ("AIza", _URL64, 35),
    ("npm_", _ALNUM, 36),
    ("eyJ", _URL64 + ".", 90),
    ("", _BASE64, 40),
    ("", _ALNUM, 32),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24),
    ("", "0123456789ABCDEF", 40),
]

FINDING = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("before", T.StringType()),
            T.StructField("body", T.StringType()),
            T.StructField("after", T.StringType()),
        ]
    )
)
_FINDING_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])
)


# Candidates ----------------------------------------------------------------------


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, by start and kind."""
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def candidate_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end bytes of runs that may be a secret: long enough, with a digit and a letter.

    Full stops and hyphens at the end belong to the sentence.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = _RUN[data]
    turn = np.zeros(n + 1, dtype=bool)
    turn[1:n] = inside[1:] != inside[:-1]
    turn[offsets] = True
    edge = np.flatnonzero(turn)
    start, end = edge[:-1], edge[1:]
    keep = inside[start] & (end - start >= LEAST_RUN)
    start, end = start[keep], end[keep]
    while len(start) and (loose := (data[end - 1] == 46) | (data[end - 1] == 45)).any():
        end = end - loose
        start, end = start[end > start], end[end > start]
    digits, letters = np.append(0, np.cumsum(_DIGIT[data], dtype=np.int32)), np.append(0, np.cumsum(_LETTER[data], dtype=np.int32))
    keep = (end - start >= LEAST_RUN) & (digits[end] > digits[start]) & (letters[end] > letters[start])
    start, end = start[keep], end[keep]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def _candidates_of(column: pa.Array) -> list[list[dict]]:
    """Base matches and further candidates of each text, with their contexts; positions are code points."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    out: list[list[dict]] = [[] for _ in range(len(column))]
    hinted = pc.match_substring_regex(column, _HINT).to_numpy(zero_copy_only=False)
    data, at = ragged.utf8(column)
    row, start, end = candidate_runs(data, at)
    touched = np.unique(np.concatenate([np.flatnonzero(hinted), row]))
    first, last = np.searchsorted(row, touched), np.searchsorted(row, touched, side="right")
    for i, lo, hi in zip(touched.tolist(), first.tolist(), last.tolist()):
        text = column[i].as_py()
        spans = base_matches(text) if hinted[i] else []
        taken = sorted((s, e) for _, s, e in spans)
        raw = data[at[i] : at[i + 1]]
        points = np.cumsum(~ragged.IS_TAIL[raw]) if hi > lo else raw
        begins = np.array([s for s, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else begins
        for a, b in zip((start[lo:hi] - at[i]).tolist(), (end[lo:hi] - at[i]).tolist()):
            s = int(points[a]) - 1
            e = s + b - a
            before = int(np.searchsorted(begins, e))
            if before == 0 or reach[before - 1] <= s:
                spans.append(("model", s, e))
        spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        out[i] = [
            {"kind": k, "start": s, "end": e, "before": text[max(0, s - BEFORE) : s], "body": text[s:e], "after": text[e : e + AFTER]} for k, s, e in spans
        ]
    return out


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, found``: per row its base matches and candidates with contexts, from whole texts; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_candidates_of(part.column("text")), _FINDING_ARROW)], names=["id", "found"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("found", FINDING)])
    return rows.mapInArrow(run, schema)


# Network -------------------------------------------------------------------------

#: Channels: learned ones per byte, and three that tell context before, candidate and context after.
EMBEDDING, FILTERS, WIDTH, HIDDEN = 8, 32, 5, 16
#: Characters that one pass of the network holds; longer candidates pass in parts.
PASS_CHARS = 1 << 15


def encode(items: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, segment (0, 1, 2) and item of each character of all items, one item after the other."""
    parts = [p.encode() for item in items for p in item]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    segment = np.tile(np.arange(3, dtype=np.int8), len(items))
    return np.frombuffer(b"".join(parts), np.uint8), np.repeat(segment, size), np.repeat(np.arange(len(items)).repeat(3), size)


@dataclass
class CharNet:
    """Convolution over characters; the greatest response per segment and the mean over the candidate decide."""

    weights: dict[str, np.ndarray]
    #: Logistic calibration of the output and a threshold of the calibrated score per family.
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 7) -> CharNet:
        rng = np.random.default_rng(seed)
        channels = EMBEDDING + 3
        make = lambda *shape: rng.normal(0, np.sqrt(2.0 / shape[0]), shape)
        return cls(
            {
                "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
                "conv": make(WIDTH * channels, FILTERS),
                "conv_bias": np.zeros(FILTERS),
                "dense": make(4 * FILTERS, HIDDEN),
                "dense_bias": np.zeros(HIDDEN),
                "out": make(HIDDEN, 1),
                "out_bias": np.zeros(1),
            }
        )

    def windows(self, chars: np.ndarray, segment: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Channels of each character and its neighbours of the same item, side by side."""
        x = np.concatenate([self.weights["embed"][chars], np.eye(3)[segment]], axis=1)
        n, channels, half = len(chars), EMBEDDING + 3, WIDTH // 2
        out = np.zeros((n, WIDTH * channels))
        for k in range(-half, half + 1):
            lo, hi = max(0, -k), min(n, n - k)
            if lo < hi:
                same = (item[lo:hi] == item[lo + k : hi + k])[:, None]
                out[lo:hi, (k + half) * channels : (k + half + 1) * channels] = x[lo + k : hi + k] * same
        return out

    def passes(self, chars: np.ndarray, segment: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, end, windows and responses of passes of bounded size, with their neighbours at the seams."""
        half = WIDTH // 2
        for lo in range(0, len(chars), PASS_CHARS):
            hi = min(lo + PASS_CHARS, len(chars))
            a, b = max(0, lo - half), min(len(chars), hi + half)
            w = self.windows(chars[a:b], segment[a:b], item[a:b])[lo - a : hi - a]
            yield lo, hi, w, np.maximum(w @ self.weights["conv"] + self.weights["conv_bias"], 0.0)

    def pooled(self, chars: np.ndarray, segment: np.ndarray, item: np.ndarray, n_items: int) -> np.ndarray:
        """Pooled responses per item."""
        best = np.zeros((n_items * 3, FILTERS))
        total = np.zeros((n_items, FILTERS))
        for lo, hi, _, h in self.passes(chars, segment, item):
            group = item[lo:hi] * 3 + segment[lo:hi]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            best[group[first]] = np.maximum(best[group[first]], np.maximum.reduceat(h, first, axis=0))
            body = segment[lo:hi] == 1
            if body.any():
                owner, inner = item[lo:hi][body], h[body]
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                total[owner[first]] += np.add.reduceat(inner, first, axis=0)
        size = np.maximum(np.bincount(item[segment == 1], minlength=n_items), 1)[:, None]
        return np.concatenate([best.reshape(n_items, 3 * FILTERS), total / size], axis=1)

    def raw(self, items: list[tuple[str, str, str]]) -> np.ndarray:
        """Log odds before calibration."""
        w = self.weights
        p = self.pooled(*encode(items), len(items))
        return (np.maximum(p @ w["dense"] + w["dense_bias"], 0.0) @ w["out"] + w["out_bias"])[:, 0]

    def probability(self, raw):
        """Calibrated probability of log odds."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))

    def scores(self, items: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probability of each candidate."""
        out = np.zeros(len(items))
        for lo in range(0, len(items), 512):
            out[lo : lo + 512] = self.probability(self.raw(items[lo : lo + 512]))
        return out

    def gradients(self, items: list[tuple[str, str, str]], label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss and its gradient for every weight."""
        w, n = self.weights, len(items)
        chars, segment, item = encode(items)
        size = np.maximum(np.bincount(item[segment == 1], minlength=n), 1)
        p = self.pooled(chars, segment, item, n)
        best = p[:, : 3 * FILTERS].reshape(n * 3, FILTERS)
        d = p @ w["dense"] + w["dense_bias"]
        a = np.maximum(d, 0.0)
        y = 1.0 / (1.0 + np.exp(-np.clip((a @ w["out"] + w["out_bias"])[:, 0], -30, 30)))
        loss = -np.mean(label * np.log(np.maximum(y, 1e-12)) + (1 - label) * np.log(np.maximum(1 - y, 1e-12)))
        g = ((y - label) / n)[:, None]
        out = {"out": a.T @ g, "out_bias": g.sum(axis=0)}
        g = (g @ w["out"].T) * (d > 0)
        out["dense"], out["dense_bias"] = p.T @ g, g.sum(axis=0)
        g = g @ w["dense"].T
        top = g[:, : 3 * FILTERS].reshape(n * 3, FILTERS)
        # Equal responses share the gradient of their maximum.
        ties = np.zeros((n * 3, FILTERS))
        for lo, hi, _, h in self.passes(chars, segment, item):
            group = item[lo:hi] * 3 + segment[lo:hi]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ties[group[first]] += np.add.reduceat(((h == best[group]) & (h > 0)).astype(float), first, axis=0)
        out["conv"], out["conv_bias"], out["embed"] = np.zeros_like(w["conv"]), np.zeros(FILTERS), np.zeros((256, EMBEDDING))
        channels, half, length = EMBEDDING + 3, WIDTH // 2, len(chars)
        for lo, hi, windows, h in self.passes(chars, segment, item):
            group = item[lo:hi] * 3 + segment[lo:hi]
            gh = np.where((h == best[group]) & (h > 0), top[group] / np.maximum(ties[group], 1.0), 0.0)
            body = segment[lo:hi] == 1
            gh[body] += (g[:, 3 * FILTERS :] / size[:, None])[item[lo:hi][body]] * (h[body] > 0)
            out["conv"] += windows.T @ gh
            out["conv_bias"] += gh.sum(axis=0)
            back = gh @ w["conv"].T
            for k in range(-half, half + 1):
                u, v = max(lo, -k), min(hi, length - k)
                if u < v:
                    same = (item[u:v] == item[u + k : v + k])[:, None]
                    part = back[u - lo : v - lo, (k + half) * channels : (k + half) * channels + EMBEDDING] * same
                    for j in range(EMBEDDING):
                        out["embed"][:, j] += np.bincount(chars[u + k : v + k], weights=part[:, j], minlength=256)
        return float(loss), out


def family(body: str) -> str:
    """Shape of a candidate: each has its own threshold."""
    if re.fullmatch(r"[0-9A-Fa-f]+", body):
        return "hexadecimal"
    return "alphanumeric" if body.isalnum() else "signs"


def adam(net: CharNet, moments: tuple[dict, dict, int], items: list[tuple[str, str, str]], label: np.ndarray, batch: int) -> tuple[dict, dict, int]:
    """One pass of Adam over the findings in their order; changes the weights, returns the moments and steps."""
    first, second, step = moments
    for lo in range(0, len(items), batch):
        _, gradient = net.gradients(items[lo : lo + batch], label[lo : lo + batch])
        step += 1
        for k, g in gradient.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return first, second, step


def still(net: CharNet) -> tuple[dict, dict, int]:
    """Moments before the first step."""
    return {k: np.zeros_like(v) for k, v in net.weights.items()}, {k: np.zeros_like(v) for k, v in net.weights.items()}, 0


def raw_scores(net: CharNet, items: list[tuple[str, str, str]]) -> np.ndarray:
    return np.concatenate([net.raw(items[lo : lo + 512]) for lo in range(0, len(items), 512)]) if items else np.zeros(0)


def train(items: list[tuple[str, str, str]], label: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS, batch: int = 64, seed: int = 7) -> CharNet:
    """Fit by Adam on three quarters of findings at hand; calibrate and set the thresholds on the rest.

    The threshold of a family is the greatest that still finds ``recall`` of its held-out secrets; a family
    without any takes that of all. Without secrets or without others nothing is ever found.
    """
    net, rng = CharNet.start(seed), np.random.default_rng(seed)
    if len(items) < 8 or label.min() == label.max():
        net.thresholds = {"": 2.0}
        return net
    order = rng.permutation(len(items))
    held, used = order[: len(items) // 4], order[len(items) // 4 :]
    moments = still(net)
    for _ in range(epochs):
        rng.shuffle(used)
        moments = adam(net, moments, [items[i] for i in used], label[used], batch)
    x, y = raw_scores(net, [items[i] for i in held]), label[held]

    def sums(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        design = np.stack([x, np.ones(len(x))], axis=1)
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ theta, -30, 30)))
        return design.T @ (y - p), (design * (p * (1 - p))[:, None]).T @ design

    calibrate(net, sums)
    kinds = np.array([family(items[i][1]) for i in held])
    for kind in ("", "hexadecimal", "alphanumeric", "signs"):
        own = np.sort(x[(y > 0) & ((kinds == kind) if kind else True)])
        if len(own):
            net.thresholds[kind] = net.probability(float(own[int((1 - recall) * len(own))]))
    net.thresholds.setdefault("", 2.0)
    return net


def calibrate(net: CharNet, sums, steps: int = 30) -> None:
    """Logistic calibration by Newton's method; ``sums(theta)`` gives the gradient and the curvature of all held-out findings."""
    start = theta = np.array([1.0, 0.0])
    for _ in range(steps):
        slope, curve = sums(theta)
        change = np.linalg.solve(curve + np.eye(2), slope - (theta - start))
        theta = theta + change
        if np.abs(change).max() < 1e-10:
            break
    net.slope, net.shift = float(max(theta[0], 1e-3)), float(theta[1])


def planted(contexts: list[tuple[str, str, str]], n: int, seed: int = 11, at: int = 0) -> list[tuple[str, str, str]]:
    """``n`` secrets of the published formats in contexts of real candidates."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        prefix, alphabet, length = FORMATS[(at + i) % len(FORMATS)]
        body = prefix + "".join(alphabet[j] for j in rng.integers(0, len(alphabet), length))
        before, _, after = contexts[int(rng.integers(0, len(contexts)))] if contexts else ("", "", "")
        out.append((before, body, after))
    return out


def labelled(found: DataFrame, n_others: int) -> DataFrame:
    """``key, before, body, after, label``: every finding, and planted keys in the contexts of all other candidates.

    Matches of the fixed patterns and planted keys are secrets, other candidates are not. ``key`` is a hash of
    row, place and copy, so the parts of the fit do not depend on how the rows lie.
    """
    each = found.select("id", F.explode("found").alias("f")).select("id", "f.*")
    own = each.select(
        F.xxhash64(F.col("id").cast("string"), "start", "kind", "body", F.lit(-1)).alias("key"), "before", "body", "after",
        (F.col("kind") != "model").cast("double").alias("label"),
    )
    copies = max(PLANTED_EACH, -(-LEAST_PLANTED // max(n_others, 1)))
    places = each.where("kind = 'model'").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    keyed = places.select(F.xxhash64(F.col("id").cast("string"), "start", "kind", "body", "copy").alias("key"), "before", "after")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [k % (1 << 63) for k in batch.column("key").to_pylist()]
            bodies = [planted([], 1, k, k % len(FORMATS))[0][1] for k in drawn]
            ones = pa.array(np.ones(len(drawn)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("before"), pa.array(bodies, pa.string()), batch.column("after"), ones], schema=_LABELLED_ARROW)

    return own.unionByName(keyed.mapInArrow(plant, _LABELLED))


_LABELLED = "key bigint, before string, body string, after string, label double"
_LABELLED_ARROW = pa.schema([("key", pa.int64()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string()), ("label", pa.float64())])


def _average(parts: list[tuple[int, dict]]) -> dict:
    n = sum(rows for rows, _ in parts)
    return {k: sum(rows * own[k] for rows, own in parts) / n for k in parts[0][1]}


def _shard_step(shared, seed: int, epoch: int, batch: int):
    """One epoch over a shard, from the shared network and moments, in an order that follows from the keys."""

    def step(table: pa.Table) -> pa.Table:
        own, before = pickle.loads(pickle.dumps(shared.value))
        order = np.random.default_rng([seed, epoch]).permutation(table.num_rows)
        table = table.sort_by([("key", "ascending"), ("body", "ascending")]).take(pa.array(order))
        items = list(zip(*(table.column(c).to_pylist() for c in ("before", "body", "after")), strict=True))
        first, second, _ = adam(own, before, items, table.column("label").to_numpy(), batch)
        state = pickle.dumps((own.weights, first, second))
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": pa.array([len(items)], pa.int64()), "state": pa.array([state], pa.binary())})

    return step


def fit(found: DataFrame, shard_findings: int = SHARD_FINDINGS, epochs: int = EPOCHS, recall: float = RECALL, batch: int = 64, seed: int = 7) -> CharNet:
    """A network from all findings and planted keys, see :func:`labelled`; a quarter by hash calibrates and sets the thresholds.

    The findings are dealt to shards of about ``shard_findings``. In every epoch each shard goes on by Adam from
    the common weights and moments, and their means, by rows, are those of the next. The driver receives weights,
    sums and thresholds, never findings.
    """
    net = CharNet.start(seed)
    counted = found.select(F.explode("found.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "model").alias("others")).first()
    if counted["n"] < 8 or not counted["others"]:
        net.thresholds = {"": 2.0}
        return net
    rows = stored(labelled(found, counted["others"]), "labelled")
    held, used = rows.where("pmod(key, 4) = 0"), rows.where("pmod(key, 4) <> 0")
    n_shards = max(1, -(-used.count() // shard_findings))
    dealt = used.withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(n_shards)))
    moments = still(net)
    for epoch in range(epochs):
        shared = found.sparkSession.sparkContext.broadcast((net, moments))

        parts = [(r["n"], pickle.loads(r["state"])) for r in dealt.groupBy("shard").applyInArrow(_shard_step(shared, seed, epoch, batch), "shard bigint, n bigint, state binary").orderBy("shard").collect()]
        net.weights = _average([(n, s[0]) for n, s in parts])
        steps = moments[2] + max(-(-n // batch) for n, _ in parts)
        moments = _average([(n, s[1]) for n, s in parts]), _average([(n, s[2]) for n, s in parts]), steps
    _set_thresholds(net, held, recall)
    return net


def _set_thresholds(net: CharNet, held: DataFrame, recall: float) -> None:
    """Calibration and thresholds from all held-out findings, by sums and ranks in Spark."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = list(zip(*(b.column(c).to_pylist() for c in ("before", "body", "after")), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([family(i[1]) for i in items], pa.string()), pa.array(raw_scores(shared.value, items)), b.column("label")], names=["family", "x", "y"])

    scored = stored(held.mapInArrow(judge, "family string, x double, y double"), "held")

    def sums(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("x") * float(theta[0]) + float(theta[1])))
        rows = scored.select("x", "y", (1.0 / (1.0 + F.exp(-z))).alias("p")).select("x", (F.col("y") - F.col("p")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        r = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("x") * F.col("g"), F.col("g"), F.col("x") * F.col("x") * F.col("h"), F.col("x") * F.col("h"), F.col("h"))]).first()
        return np.array([r[0], r[1]]), np.array([[r[2], r[3]], [r[3], r[4]]])

    calibrate(net, sums)
    secrets = scored.where("y > 0").select(F.explode(F.array(F.lit(""), "family")).alias("family"), "x")
    counts = stored(secrets.groupBy("family", "x").agg(F.count("*").alias("cnt")), "heldcounts")
    ranked = running_sums(counts, ["family"], ["x"], {"cum": F.col("cnt")})
    total = {r["family"]: r["n"] for r in counts.groupBy("family").agg(F.sum("cnt").alias("n")).collect()}
    for kind, n in total.items():
        at = ranked.where((F.col("family") == kind) & (F.col("cum") > int((1 - recall) * n))).agg(F.min("x")).first()[0]
        net.thresholds[kind] = float(net.probability(at))
    net.thresholds.setdefault("", 2.0)


def scan(found: DataFrame, net: CharNet, id_col: str = "doc_id") -> DataFrame:
    """Findings of each row of :func:`findings`: base matches stay, candidates stay from their family's threshold on.

    Every base match and candidate is scored. Returns ``id_col, n_assign, n_access, n_hex, base_sha256, spans,
    findings`` with kind, span and score of each finding.
    """
    import hashlib

    shared = found.sparkSession.sparkContext.broadcast(net)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            lists = batch.column("found").to_pylist()
            flat = [f for own in lists for f in own or ()]
            score = iter(net.scores([(f["before"], f["body"], f["after"]) for f in flat]).tolist())
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, spans, kept_rows = [], [], []
            for own in lists:
                kept = []
                for f in own or ():
                    s = next(score)
                    if f["kind"] != "model" or s >= net.thresholds.get(family(f["body"]), net.thresholds[""]):
                        kept.append({"kind": f["kind"], "start": f["start"], "end": f["end"], "score": s})
                for k in BASE:
                    counts[k].append(sum(f["kind"] == k for f in kept))
                name = lambda f: f"{f['kind']}:{f['start']}:{f['end']}"
                digests.append(hashlib.sha256(",".join(name(f) for f in kept if f["kind"] != "model").encode()).hexdigest())
                spans.append(",".join(map(name, kept)))
                kept_rows.append(kept)
            columns = [batch.column("id"), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(digests), pa.array(spans), pa.array(kept_rows, kind_of)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])

    kind = found.schema["id"].dataType.simpleString()
    out = found.mapInArrow(
        run,
        f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, findings array<struct<kind:string,start:int,end:int,score:double>>",
    )
    return out.withColumnRenamed("id", id_col)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: CharNet | None = None) -> DataFrame:
    """Secrets of every whole text; without ``net`` one is trained on the findings of ``docs``.

    Null and empty texts have none. Repeated rows are scanned alike, null ids kept; extra columns are
    ignored. An empty table gives no rows, and a network that finds nothing. A candidate that overlaps a
    base match is left to it. Findings stand by start, then kind.
    """
    found = stored(findings(docs, id_col, text_col), "findings")
    return scan(found, net or fit(found), id_col)
