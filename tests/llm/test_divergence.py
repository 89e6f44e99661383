"""Divergence of sources against plain integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from fairspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """Every price by the definition, term by term."""
    held, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        held[lang, source].update(found)
        df[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        total = {t: sum(held[lang, s][t] for s in sources) for t in kept}
        shares = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[u] for u in kept) + len(kept)) for t in kept}
        p = {s: shares(held[lang, s]) for s in sources}
        q = shares(total)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if held[lang, s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                ranked = sorted(values, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_gallop_finds_the_places():
    rng = np.random.default_rng(1)
    for n, m in [(0, 5), (5, 0), (1, 1), (3, 4000), (500, 400), (4000, 7), (64, 64), (65, 1000)]:
        few, many = np.unique(rng.integers(0, 3000, n)), np.unique(rng.integers(0, 3000, m))
        assert (divergence.gallop(few, many) == np.searchsorted(many, few)).all()


def test_pair_prices_cover_either_side():
    rng = np.random.default_rng(2)
    for n, m in [(0, 3), (4, 0), (0, 0), (30, 5), (7, 200), (90, 90)]:
        a, b = np.unique(rng.integers(0, 250, n)), np.unique(rng.integers(0, 250, m))
        x, y = rng.integers(1, 50, len(a)), rng.integers(1, 50, len(b))
        there, back, present = divergence.compare((a, x, 5000), (b, y, 700))
        x, y = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
        p = lambda t: 1 + 10**9 * (x.get(t, 0) + 1) // 5000
        q = lambda t: 1 + 10**9 * (y.get(t, 0) + 1) // 700
        either = set(x) | set(y)
        assert (there, back, present) == (sum((p(t) - q(t)) ** 2 // q(t) for t in either), sum((p(t) - q(t)) ** 2 // p(t) for t in either), len(either))


def test_shares_of_very_large_counts_are_exact(spark):
    counts, size = [0, 8_999_999_999, 9_000_000_000, 2 * 10**14], 10**15 + 7
    want = [1 + 10**9 * (c + 1) // size for c in counts]
    assert divergence.share(np.array(counts), size).tolist() == want
    rows = spark.createDataFrame([(c, size) for c in counts], "n bigint, size bigint")
    assert [r[0] for r in rows.select(divergence._share("n", "size")).collect()] == want


def test_equals_plain_arithmetic(make):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        lang = rnd.choice(["en", "de", None])
        source = rnd.choice(["big"] * 6 + [f"s{k}" for k in range(19)])  # more than two tiles, one dominant source
        words = [rnd.choice("abcdefgh") * rnd.randint(1, 4) + rnd.choice(["", "É", "x1y", "'s"]) for _ in range(rnd.randint(0, 30))]
        rows.append((i, " ".join(words), lang, source))
    rows.append((900, "", "en", "silent"))
    assert found(divergence.source_divergence(make(rows), top=7)) == plain(rows, top=7)


def test_odd_rows(odd, make):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert found(divergence.source_divergence(odd)) == plain(rows)
    assert found(divergence.source_divergence(odd, least_docs=1)) == plain(rows, least=1)


def test_no_kept_terms_and_no_rows(make):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "fr", "a")]
    assert found(divergence.source_divergence(make(rows))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert found(divergence.source_divergence(make([]))) == []


def test_ties_go_to_the_lesser_item(make):
    rows = [(i, "x y z", "en", s) for i, s in enumerate("aabbcc")]
    out = found(divergence.source_divergence(make(rows)))
    assert [r[3:] for r in out if r[1] == "a"] == [("b", 0, 1), ("c", 0, 2)]
