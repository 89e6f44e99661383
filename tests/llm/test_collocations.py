"""The FM-index against plain counting, and phrases against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from fairspark.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(rows, least=10, most=3, top=2000):
    f, left, right, n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    p = tuple(w[i : i + m])
                    f[lang][p] += 1
                    left[lang][p] += i > 0
                    right[lang][p] += i + m < len(w)
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in cands.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(inside(q) and 100 * b >= 50 * a for q, b in cands.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], left[lang][p], right[lang][p]))
        kept.sort()
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s, lf, rf) for i, (s, a, p, l, r, lf, rf) in enumerate(kept[:top], 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_f", "right_f"]
    return sorted(tuple(r) for r in df.collect())


def test_index_enumerates_all_phrases_with_their_intervals():
    rng = np.random.default_rng(4)
    for size, kinds in [(0, 3), (1, 2), (400, 5), (2000, 40)]:
        ids = np.concatenate([[0], rng.integers(0, kinds, size), [0]])
        index = co.BidirectionalIndex(*[co.transform(x, 5).astype(np.int64) for x in (ids, ids[::-1])])
        level, known = index.words(), []
        for m in range(1, 6):
            level, key = co.in_order(index.longer(level, known) if m > 1 else level, known)
            if m == 1:
                keep = level.count > 0
                level, key = level.only(keep), key[keep]
            known.append(key)
            windows = [tuple(ids[i : i + m].tolist()) for i in range(len(ids) - m + 1)]
            want = Counter(w for w in windows if 0 not in w)
            assert dict(zip(map(tuple, level.words.tolist()), level.count.tolist())) == dict(want)
            before, after = index.neighbours(level)
            wider = [tuple(ids[i : i + m + 1].tolist()) for i in range(len(ids) - m)]
            lefts = Counter(w[1:] for w in wider if w[0] and 0 not in w[1:])
            rights = Counter(w[:-1] for w in wider if w[-1] and 0 not in w[:-1])
            for w, b, a in zip(map(tuple, level.words.tolist()), before.tolist(), after.tolist()):
                assert (b, a) == (lefts[w], rights[w])


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["of", "the", "New", "York", "new", "city", "éa", "日本", "x", "-", "b-b", "it's"]
    rows = []
    for i in range(n):
        words = [rnd.choice(["in the end", "New York City", "of the", *vocabulary]) + rnd.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rnd.randint(0, 40))]
        rows.append((i, " ".join(words), rnd.choice(["en", "en", "en", "de", None]), "web"))
    return rows


def test_equals_plain_counting_over_several_shards(make):
    rows = texts(1, 300)
    docs = make(rows).repartition(3)
    assert found(co.collocations(docs, shard_words=500)) == plain(rows)
    assert found(co.collocations(docs, least=4, most_words=5, top=60)) == plain(rows, least=4, most=5, top=60)


def test_two_words_only(make):
    rows = texts(2, 120)
    assert found(co.collocations(make(rows), least=6, most_words=2)) == plain(rows, least=6, most=2)


def test_odd_rows_and_long_pieces(odd, make):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert found(co.collocations(odd, least=3, shard_words=1000)) == plain(rows, least=3)
    one = [(1, "a b " * 5000, "en", "web"), (2, "a b", "en", "web"), (3, ". " * 300 + "c d " * 20, "en", "web")]
    assert found(co.collocations(make(one), shard_words=100)) == plain(one)
    assert found(co.collocations(make([]))) == []
    assert found(co.collocations(make([(1, None, None, None), (2, " ,.", "en", "web")]))) == []


def test_ties_in_score_and_cut(make):
    rows = [(i, "a b c. d e f. f e d.", "en", "web") for i in range(10)]
    assert found(co.collocations(make(rows))) == plain(rows)


def test_few_places_cut_by_score_bands(make):
    """Ties over the cut, bands of one candidate and languages with fewer candidates than places."""
    rows = texts(5, 200) + [(1000 + i, "p q. r s. t u", "fr", "web") for i in range(10)]
    for top in (1, 2, 7):
        assert found(co.collocations(make(rows), least=4, top=top)) == plain(rows, least=4, top=top)


def test_sorted_places_in_one_number_or_by_key():
    """Both ways of sorting agree with a stable sort, and an index builds only the direction that a length needs."""
    key = np.random.default_rng(1).integers(0, 40, 500)
    for most in (40, 1 << 60):
        ascending, order = co.sorted_places(key, most)
        assert (order == np.argsort(key, kind="stable")).all() and (ascending == key[order]).all()
    assert [len(x) for x in co.sorted_places(key[:0], 40)] == [0, 0]
    ids = np.append(0, np.random.default_rng(2).integers(0, 9, 300))
    ids = np.append(ids, 0)
    index = co.BidirectionalIndex(co.transform(ids, 3), co.transform(ids[::-1], 3))
    built = lambda: ["places" in vars(d) for d in (index.forward, index.backward)]
    level, key = co.in_order(index.words(), [])
    assert built() == [False, False]
    pairs = index.longer(level, [key])
    assert built() == [True, False]
    found = {tuple(w): n for w, n in zip(pairs.words.tolist(), pairs.count.tolist())}
    both = [(a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist()) if a and b]
    assert found == {p: both.count(p) for p in set(both)}


def test_shards_hold_their_words_once(make):
    """Four bytes a word or separator, in planes, and the index built from them, each direction when it is needed."""
    ids = np.random.default_rng(3).integers(0, 70_000, 999)
    data = co.packed_ids(ids)
    assert data[3 * 999 :] == bytes(999) and (co.unpacked_ids(data) == ids).all()
    rows = co.shards(make(texts(6, 60)).coalesce(1), shard_words=200).toArrow()
    assert sum(rows.column("n_words").to_pylist()) == sum(len(w) for r in texts(6, 60) for w in pieces(r[1]))
    for data, n in zip(rows.column("ids").to_pylist(), rows.column("n_words").to_pylist()):
        ids = co.unpacked_ids(data)
        assert ids[0] == ids[-1] == 0 and (ids > 0).sum() == n and len(data) == 4 * len(ids)
        index, eager = co.TextIndex(ids, 3), co.BidirectionalIndex(co.transform(ids, 3), co.transform(ids[::-1], 3))
        level, key = co.in_order(index.words(), [])
        assert not {"forward", "backward"} & set(vars(index))
        level = index.longer(level, [key])
        assert "forward" in vars(index) and "backward" not in vars(index)
        other = eager.longer(eager.words(), [key])
        assert (level.words == other.words).all() and (level.count == other.count).all()
        assert all((a == b).all() for a, b in zip(index.neighbours(level), eager.neighbours(other)))


def test_reports_are_half_a_hash_and_a_short_count(make, monkeypatch):
    """Many parts, and counts that need one byte or two."""
    rows = texts(7, 250)
    docs = make(rows).repartition(2)
    monkeypatch.setattr(co, "PART_ENTRIES", 150)
    for least in (4, 300):
        assert found(co.collocations(docs, least=least, shard_words=400)) == plain(rows, least=least)
    keys = np.random.default_rng(8).integers(0, 1 << 63, 1000).astype(np.uint64)
    dealt = list(co._by_part(keys, 7))
    assert sorted(np.concatenate([at for _, at in dealt]).tolist()) == list(range(1000))
    # The part depends on the lower half alone, so that the upper one can tell all phrases of a part apart.
    high = keys ^ (np.uint64(5) << np.uint64(40))
    assert all(k == q and (at == other).all() for (k, at), (q, other) in zip(dealt, co._by_part(high, 7)))
