"""How far the term distributions of sources lie apart, pair by pair, in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairspark.llm import ragged
from fairspark.llm.tables import stored

#: Probabilities are counted in parts of this many.
SCALE = 1_000_000_000
#: A term is kept if so many documents of its language hold it.
LEAST_DOCS = 3
#: Terms reported per source.
TOP_TERMS = 200
#: Sources of a language that share a tile: a pair task compares two tiles over one block of terms.
TILE = 8
#: Each run of so many ids starts its gallop anew.
RUN = 64
SLICE_BYTES = 16 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z lower-cased, bytes outside terms blank.
_FOLD = np.where(_TERM, ragged.LOWER, 32).astype(np.uint8)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Partial counts ``lang, source, term, n, df`` of slices of the documents; nothing is shuffled."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                data, at = ragged.utf8(part.column("text"))
                pieces = ragged.cut(_FOLD[data], at, ragged.SPACE_CUTS, skip_spaces=True)
                lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
                n_sources = max(len(source.dictionary), 1)
                group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
                kinds = max(len(pieces.values), 1)
                in_doc, n = np.unique(pieces.row * kinds + pieces.code, return_counts=True)
                key, place = np.unique(group[in_doc // kinds] * kinds + in_doc % kinds, return_inverse=True)
                owner, code = key // kinds, key % kinds
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(owner // n_sources)),
                        source.dictionary.take(pa.array(owner % n_sources)),
                        pieces.values.take(pa.array(code)).cast(pa.binary()).cast(pa.string()),
                        pa.array(np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)),
                        pa.array(np.bincount(place, minlength=len(key)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")


def vocabulary(partials: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Kept terms: ``id, lang, term, total, counts`` with one (source, n) per source that has the term.

    One exchange by (language, term) serves both groupings; a frequent term costs one row per slice and
    source. The list of a term is as long as its language has sources.
    """
    dealt = partials.repartition("lang", "term")
    per_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = per_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = terms.where(F.col("df") >= least_docs)
    return stored(kept.select(F.monotonically_increasing_id().alias("id"), "lang", "term", "total", "counts"), "terms")


def _share(count: str, size: str) -> Column:
    """1 + floor(SCALE * (count + 1) / size); beyond 64 bits in decimals."""
    fits = f"{SCALE} * ({count} + 1) div {size}"
    wide = f"cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({size} as decimal(20,0))"
    return F.expr(f"1 + case when {count} < 9000000000 then {fits} else {wide} end")


def _price(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def share(count: np.ndarray, size: int) -> np.ndarray:
    """The same in arrays: ``count`` plus one per ``size``, in parts of ``SCALE``."""
    if len(count) and int(count.max()) >= 9_000_000_000:
        return np.array([1 + SCALE * (int(c) + 1) // size for c in count], dtype=np.int64)
    return 1 + SCALE * (count + 1) // size


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Place of each of the ascending ``few`` in the ascending ``many``.

    From the place of its run's first value each search doubles its step until it has passed the value,
    then halves the last step; all searches move together.
    """
    n = len(many)
    low = np.repeat(np.searchsorted(many, few[::RUN]), RUN)[: len(few)]
    step = np.ones(len(few), dtype=np.int64)
    going = np.flatnonzero(low < n)
    going = going[many[low[going]] < few[going]]
    while len(going):
        # many[low] is less than the value here.
        ahead = low[going] + step[going]
        inside = ahead < n
        passed = np.ones(len(going), dtype=bool)
        passed[inside] = many[ahead[inside]] >= few[going][inside]
        on = going[~passed]
        low[on] += step[on]
        step[on] *= 2
        stop = going[passed]
        bottom, top = low[stop] + 1, np.minimum(ahead[passed], n)
        while len(stop) and (open_ := bottom < top).any():
            middle = (bottom + top) // 2
            less = np.zeros(len(stop), dtype=bool)
            less[open_] = many[middle[open_]] < few[stop[open_]]
            bottom, top = np.where(open_ & less, middle + 1, bottom), np.where(open_ & ~less, middle, top)
        low[stop] = bottom
        going = on
    return low


def compare(a: tuple, b: tuple) -> tuple[int, int, int]:
    """Summed prices of (ids, counts, size) ``a`` against ``b`` and back, and the number of terms that either has.

    Both sides are priced over the terms that either one has; a missing term has count 0.
    """
    (ids_a, n_a, size_a), (ids_b, n_b, size_b) = a, b
    p, q = share(n_a, size_a), share(n_b, size_b)
    none = np.zeros(1, dtype=np.int64)
    p0, q0 = share(none, size_a)[0], share(none, size_b)[0]
    if len(ids_a) <= len(ids_b):
        place = gallop(ids_a, ids_b)
        hit = place < len(ids_b)
        hit[hit] = ids_b[place[hit]] == ids_a[hit]
        both_a, both_b = hit, np.zeros(len(ids_b), dtype=bool)
        both_b[place[hit]] = True
    else:
        place = gallop(ids_b, ids_a)
        hit = place < len(ids_a)
        hit[hit] = ids_a[place[hit]] == ids_b[hit]
        both_b, both_a = hit, np.zeros(len(ids_a), dtype=bool)
        both_a[place[hit]] = True
    pa_, qb, only_a, only_b = p[both_a], q[both_b], p[~both_a], q[~both_b]
    there = price(pa_, qb).sum() + price(only_a, q0).sum() + price(p0, only_b).sum()
    back = price(qb, pa_).sum() + price(q0, only_a).sum() + price(only_b, p0).sum()
    return int(there), int(back), len(only_a) + len(only_b) + len(pa_)


def term_arrays(terms: DataFrame) -> DataFrame:
    """Ascending ids and counts of each (lang, source) over each block of terms, as bytes of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = batch.column("counts")
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(at[0], at[-1] - at[0])
            lang, source = batch.column("lang").dictionary_encode(), flat.field("source").dictionary_encode()
            n_sources = max(len(source.dictionary), 1)
            size = np.diff(at)
            ids = np.repeat(batch.column("id").to_numpy(), size)
            group = np.repeat(lang.indices.to_numpy().astype(np.int64), size) * n_sources + source.indices.to_numpy()
            n = flat.field("n").to_numpy()
            order = np.lexsort((ids, group))
            ids, group, n = ids[order], group[order], n[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(group))
            owner = group[first]
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(owner // n_sources)),
                    source.dictionary.take(pa.array(owner % n_sources)),
                    pa.array(np.full(len(first), task + block), pa.int64()),
                    pa.array([ids[i:j].tobytes() for i, j in zip(first, last)], pa.binary()),
                    pa.array([n[i:j].tobytes() for i, j in zip(first, last)], pa.binary()),
                ],
                names=["lang", "source", "block", "ids", "ns"],
            )
            block += 1

    return terms.select("id", "lang", "counts").mapInArrow(run, "lang string, source string, block bigint, ids binary, ns binary")


def pair_prices(arrays: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, there, back, present`` per unordered pair of source numbers, summed over the blocks.

    A pair task holds two tiles of sources over one block of terms: at most ``2 * TILE`` arrays of a
    block, whatever the size of a source. ``members`` tells it which sources a tile has, so that a source
    without terms in the block is priced too.
    """
    dims = groups.select("lang", "source", "number", "size", F.floor(F.col("number") / TILE).cast("int").alias("tile"))
    tiles = dims.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("number", "size"))).alias("members"))
    others = tiles.select("lang", F.col("tile").alias("other"), F.col("members").alias("other_members"))
    rows = arrays.join(dims, ["lang", "source"]).join(tiles, ["lang", "tile"])
    n_tiles = tiles.groupBy("lang").agg((F.max("tile") + 1).alias("n_tiles"))
    rows = rows.join(n_tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))).join(others, ["lang", "other"])
    turned = F.col("other") < F.col("tile")
    rows = rows.select(
        "lang",
        F.least("tile", "other").alias("tile_a"),
        F.greatest("tile", "other").alias("tile_b"),
        "block",
        "number",
        "ids",
        "ns",
        F.when(turned, F.col("other_members")).otherwise(F.col("members")).alias("members_a"),
        F.when(turned, F.col("members")).otherwise(F.col("other_members")).alias("members_b"),
    )

    def run(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        held = {
            k: (np.frombuffer(i, np.int64), np.frombuffer(n, np.int64))
            for k, i, n in zip(group.column("number").to_pylist(), group.column("ids").to_pylist(), group.column("ns").to_pylist())
        }
        a, b = group.column("members_a")[0].as_py(), group.column("members_b")[0].as_py()
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out: list[tuple] = []
        for x in a:
            for y in b:
                i, j = x["number"], y["number"]
                if i < j and (i in held or j in held):
                    out.append((i, j, *compare((*held.get(i, nothing), x["size"]), (*held.get(j, nothing), y["size"]))))
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "there", "back", "present"), columns)}})

    priced = rows.groupBy("lang", "tile_a", "tile_b", "block").applyInArrow(run, "lang string, a bigint, b bigint, there bigint, back bigint, present bigint")
    return priced.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("there", "back", "present")])


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of sources of a language, and each source's own terms.

    Terms are runs of letters (ASCII letters, A-Z lower-cased, and all characters beyond ASCII); a language
    keeps those in at least ``least_docs`` of its documents. With add-one shares ``p`` of a source and ``q``
    of another one, a term's price is ``floor((p - q)^2 / q)``. Part ``pair`` sums it over all kept terms for
    each other source of the language. Part ``term`` prices the terms that the source has more often than
    its language and returns the first ``top``. Ties go to the lesser item by UTF-8 bytes.

    Sorted arrays of two sources meet in a task per pair of tiles and block of terms; terms that neither
    has are priced once per pair at the end. So a dominant source is spread over blocks.

    Null texts, languages and sources are empty. Each row is a document, repeated ones too. A source
    without terms has count 0 everywhere; a language without kept terms has distance 0 between its
    sources; an empty table gives none. Extra columns are ignored.
    """
    terms = vocabulary(term_counts(docs, lang_col, source_col, text_col), least_docs)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    occurring = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    entries = terms.select("id", "lang", "term", "total", F.explode("counts").alias("c")).select("id", "lang", "term", "total", "c.source", "c.n")
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_own"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    groups = groups.select(
        "lang",
        "source",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("number"),
        (zero("n_own") + zero("v")).alias("size"),
        zero("v").alias("v"),
        (zero("n_lang") + zero("v")).alias("lang_size"),
    )
    groups = stored(groups, "groups")

    sums = pair_prices(term_arrays(terms), groups)
    sums = stored(sums, "pairs")
    left = groups.select("lang", "source", "number", "size", "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("item_number"), F.col("size").alias("item_size"))
    pairs = left.join(right, "lang").where("number <> item_number")
    both = sums.select("lang", F.col("a").alias("number"), F.col("b").alias("item_number"), F.col("there").alias("sum"), "present").unionByName(
        sums.select("lang", F.col("b").alias("number"), F.col("a").alias("item_number"), F.col("back").alias("sum"), "present")
    )
    pairs = pairs.join(both, ["lang", "number", "item_number"], "left")
    pairs = pairs.withColumn("n0", F.lit(0).cast("bigint"))
    pairs = pairs.withColumn("p0", F.when(F.col("v") > 0, _share("n0", "size"))).withColumn("q0", F.when(F.col("v") > 0, _share("n0", "item_size")))
    absent = (F.col("v") - zero("present")) * _price("p0", "q0")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (zero("sum") + F.coalesce(absent, F.lit(0))).cast("bigint").alias("value"))

    priced = entries.join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
    priced = priced.select("lang", "source", F.col("term").alias("item"), _share("n", "size").alias("p"), _share("total", "lang_size").alias("q")).where("p > q")
    priced = priced.select("lang", "source", F.lit("term").alias("part"), "item", _price("p", "q").cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    own_terms = priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(own_terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))


DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
grp AS (SELECT lang, source, coalesce(sum(n), 0) AS n_own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
f AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // (n_own + v)::HUGEINT AS p,
    1 + ({SCALE}::HUGEINT * (total + 1)) // (n_lang + v)::HUGEINT AS q
  FROM grp JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)
),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
),
ranked AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM f WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
