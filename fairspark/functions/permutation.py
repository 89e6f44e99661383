"""Exact random relabelling at scale.

A permutation ``p`` orders the rows of a group by a random-coefficient cubic
polynomial of the row id modulo a prime (four-wise independent keys) and labels the
first ``m`` rows. The keys depend on (id, seed, p) only, so every pass, retry and
re-run sees the same labels, and SQL can reproduce them. Spark partitions the rows;
inside a task all permutations of a batch are evaluated as one NumPy matrix.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2**31 - 1
BINS = 30
#: Cuts that one pass holds in its tasks.
MOST_CUTS = 5_000_000
#: Rows of which a task holds the keys of all permutations at once.
ROWS_PER_MATRIX = 2_000


def coefficients(n_perm: int, seed: int) -> np.ndarray:
    """Five 28-bit coefficients per permutation from md5('seed|perm|j')."""
    draw = lambda p, j: int(hashlib.md5(f"{seed}|{p}|{j}".encode()).hexdigest()[:7], 16)
    return np.array([[draw(p, j) for p in range(n_perm)] for j in range(5)], dtype=np.int64)


def key_matrix(ids: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Keys of every (row, permutation); all products stay below 2**63."""
    x = (ids % PRIME)[:, None]
    high = (ids // PRIME % PRIME)[:, None]
    key = (coef[3] * x + coef[2]) % PRIME
    key = (key * x + coef[1]) % PRIME
    key = (key * x + coef[0]) % PRIME
    return (key + coef[4] * high) % PRIME if high.any() else key


def _window(n: int, m: int) -> tuple[int, int]:
    """Start and bin width of the key range in which the ``m``-th of ``n`` uniform keys lies.

    Six deviations on both sides; a cut outside only makes the outer bins larger.
    """
    half = 3.0 / math.sqrt(max(n, 1))
    low = max(0, int((m / max(n, 1) - half) * PRIME))
    return low, max(1, math.ceil(2 * half * PRIME / BINS))


def _bins(keys: np.ndarray, window: tuple[int, int]) -> np.ndarray:
    """0 below the window, 1..BINS inside, BINS + 1 above."""
    return np.clip((keys - window[0]) // window[1] + 1, 0, BINS + 1)


def _histograms(coef: np.ndarray, windows: dict):
    n_perm, width = coef.shape[1], BINS + 2
    offset = np.arange(n_perm, dtype=np.int64) * width

    def rows_of(acc: dict) -> pd.DataFrame:
        return pd.DataFrame(
            [(g, b, row.tolist()) for g, m in acc.items() for b, row in enumerate(m.T)], columns=["grp", "bucket", "counts"]
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                ids = part["id"].to_numpy()
                for lo in range(0, len(ids), ROWS_PER_MATRIX):
                    flat = (_bins(key_matrix(ids[lo : lo + ROWS_PER_MATRIX], coef), windows[g]) + offset).ravel()
                    found = np.bincount(flat, minlength=n_perm * width).reshape(n_perm, width)
                    acc[g] = acc[g] + found if g in acc else found
            if len(acc) > 100:
                yield rows_of(acc)
                acc = {}
        if acc:
            yield rows_of(acc)

    return run


def _edge_rows(coef: np.ndarray, windows: dict, edges: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                every = part["id"].to_numpy()
                for lo in range(0, len(every), ROWS_PER_MATRIX):
                    ids = every[lo : lo + ROWS_PER_MATRIX]
                    keys = key_matrix(ids, coef)
                    at, perm = np.nonzero(_bins(keys, windows[g]) == edges[g][None, :])
                    yield pd.DataFrame({"grp": g, "perm": perm.astype(np.int32), "key": keys[at, perm], "id": ids[at]})

    return run


def permutation_cuts(rows: DataFrame, sizes: DataFrame, n_perm: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Key and id of the ``m``-th row of every (group, permutation).

    ``rows(grp, id)`` are the data, ``sizes(grp, n, m)`` the group sizes. Two passes:
    histograms of the keys, fine around the expected place of the cut, find the bin that
    holds it, then only the rows of that bin are ranked. The driver receives one cut per
    group and permutation.
    """
    total = {r["grp"]: (r["n"], r["m"]) for r in sizes.collect()}
    windows = {g: _window(n, m) for g, (n, m) in total.items()}
    coef = coefficients(n_perm, seed)
    hist = rows.mapInPandas(_histograms(coef, windows), "grp string, bucket int, counts array<bigint>")
    long = hist.select("grp", "bucket", F.posexplode("counts").alias("perm", "cnt")).where("cnt > 0")
    counts = long.groupBy("grp", "perm", "bucket").agg(F.sum("cnt").alias("cnt")).join(sizes, "grp")
    upto = Window.partitionBy("grp", "perm").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("m") - (F.sum("cnt").over(upto) - F.col("cnt"))
    edge = counts.withColumn("room", room).where("room > 0 AND room <= cnt").select("grp", "perm", "bucket", "room")
    edges = {g: np.full(n_perm, -1, dtype=np.int64) for g in total}
    rooms = []
    for r in edge.collect():
        edges[r["grp"]][r["perm"]] = r["bucket"]
        rooms.append((r["grp"], r["perm"], r["room"]))
    # m = 0 leaves the impossible cut (-1), so nothing is labelled.
    cuts = {g: (np.full(n_perm, -1, dtype=np.int64), np.full(n_perm, -1, dtype=np.int64)) for g in total}
    if rooms:
        wanted = rows.sparkSession.createDataFrame(rooms, "grp string, perm int, room bigint")
        found = rows.mapInPandas(_edge_rows(coef, windows, edges), "grp string, perm int, key bigint, id bigint")
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("grp", "perm").orderBy("key", "id")))
        for r in ranked.join(wanted, ["grp", "perm"]).where("r = room").collect():
            cuts[r["grp"]][0][r["perm"]] = r["key"]
            cuts[r["grp"]][1][r["perm"]] = r["id"]
    return cuts


def labels(ids: np.ndarray, coef: np.ndarray, cut: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Boolean matrix (row, permutation): the row comes at or before the cut."""
    keys = key_matrix(ids, coef)
    return (keys < cut[0]) | ((keys == cut[0]) & (ids[:, None] <= cut[1]))
