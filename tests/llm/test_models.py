"""Scoring, language identification and toxicity against plain versions and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairspark.llm import language, queries, scoring, toxicity
from fairspark.llm.tables import id_remainder, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def base_scores(rows):
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    return n, [(d, h, len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for (d, t), h in zip(rows, held)]


def check_scores(found, rows):
    n, want = base_scores(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in found), key=key)
    assert {r["train_tokens"] for r in found} <= {n}
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_scores_equal_brute_force_and_beat_the_base(spark):
    docs = table(spark, SF, "documents")
    found = queries.op3_lm_scoring(spark, SF).collect()
    check_scores(found, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_lexicon_joins_the_rest(spark, monkeypatch):
    monkeypatch.setattr(scoring, "LEXICON", 200)
    monkeypatch.setattr(scoring, "VOCABULARY", 50)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = scoring.score_texts(docs, id_remainder(F.col("doc_id"), 7) == 2).collect()
    check_scores(found, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_score_sums_to_one(spark, make):
    rows = [(i, "a b c a b" if i % 2 else "b c d") for i in range(40)]
    every = ["", *[" ".join(p) for n in (1, 2) for p in np.array(np.meshgrid(*[list("abcdz")] * n)).T.reshape(-1, n)]]
    docs = make(rows + [(1000 + k, t) for k, t in enumerate(every)])
    found = {r["doc_id"]: r["score"] for r in scoring.score_texts(docs, F.col("doc_id") >= 1000).collect()}
    # After any word, some word or the end follows: the texts of one word hold what the empty text leaves.
    one = sum(10 ** found[1000 + k] for k, t in enumerate(every) if len(t.split()) <= 1)
    assert one < 1.0 + 1e-9
    assert found[1000] < 0


def test_training_finds_the_pairs():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(12, 0.2), 12)
    pairs = np.round(p * 5_000)
    table_ = scoring.train(pairs, dimension=12, steps=600).log10_table()
    assert np.allclose((10**table_).sum(axis=1), 1)
    fit = (pairs * table_).sum() / pairs.sum()
    unigram = (pairs * np.log10((pairs.sum(axis=0) + 1) / (pairs.sum() + 12))).sum() / pairs.sum()
    best = (pairs * np.log10(np.maximum(pairs, 1e-9) / pairs.sum(axis=1, keepdims=True))).sum() / pairs.sum()
    assert unigram < fit <= best + 1e-9 and fit > unigram + 0.7 * (best - unigram)


def test_scores_odd_rows(odd, make):
    held = id_remainder(F.col("doc_id"), 7) == 2
    check_scores(scoring.score_texts(odd, held).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert scoring.score_texts(make([]), held).count() == 0
    alone = scoring.score_texts(make([(1, "a b")]), F.lit(True)).collect()[0]
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and alone["base_score"] == 0 and alone["score"] <= 0


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in queries.op9_language_id(spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.98 * len(found)


def test_word_scores_back_off(spark, make):
    docs = make([(i, t, lang, "s") for i, (t, lang) in enumerate([("der hund und der kater", "de"), ("the hound and the cat", "en")] * 4)])
    model = language.fit(docs)
    import pyarrow as pa

    known, unseen, alien = model.word_scores(pa.array([b"der", b"hundert", b"\xe6\x97\xa5"], pa.large_binary()))
    de, en = model.languages.index("de"), model.languages.index("en")
    assert known[de] > known[en] and unseen[de] > unseen[en] and alien[de] == alien[en] == 0
    # "hundert": of its 5-grams only "^hund" is known, so its score is one entry of that level.
    assert any(math.isclose(unseen[de], v, rel_tol=1e-12) for v in model.scores[5][:, de])


def test_bounds_of_the_language_tables(make):
    docs = make([(i, f"der hund {w}", "de", "s") for i, w in enumerate(["eins", "zwei", "drei"])])
    whole, cut = language.fit(docs), language.fit(docs, most_words=2, most_grams=3)
    assert len(whole.hashes[0]) == 5 and len(cut.hashes[0]) == 2  # words that occur once are kept too
    assert all(len(cut.hashes[n]) == 3 < len(whole.hashes[n]) for n in language.ORDERS)
    assert set(cut.hashes[0]) <= set(whole.hashes[0])


def test_language_odd_rows(odd, make):
    model = language.fit(odd)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3))
    assert language.predict(make([]), model).count() == 0
    nothing = language.predict(odd, language.fit(make([]))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def index_of(vectors, toxic, n_terms):
    """An index over given sparse vectors, built the plain way."""
    entries = sorted((t, e, w) for e, v in enumerate(vectors) for t, w in v.items())
    term, example = np.array([t for t, _, _ in entries]), np.array([e for _, e, _ in entries])
    weight, block = np.array([w for _, _, w in entries]), np.array([e for _, e, _ in entries]) // toxicity.BLOCK
    starts = np.array([k for k in range(len(term)) if k == 0 or (term[k], block[k]) != (term[k - 1], block[k - 1])])
    return toxicity.ExampleIndex(
        terms=np.arange(n_terms, dtype=np.uint64), idf=np.ones(n_terms), first=np.searchsorted(term, np.arange(n_terms + 1)), example=example, weight=weight,
        block_first=np.searchsorted(term[starts], np.arange(n_terms + 1)), block=block[starts], block_most=np.maximum.reduceat(weight, starts),
        block_posting=np.append(starts, len(term)), toxic=np.array(toxic), ids=list(range(len(vectors))), n_blocks=len(vectors) // toxicity.BLOCK + 1,
        base_rate=0.1, empty_score=0.05,
    )


def test_nearest_is_exact():
    rng = random.Random(9)
    vectors = []
    for _ in range(700):
        v = {t: rng.random() + 0.01 for t in rng.sample(range(60), rng.randint(1, 8))}
        size = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / size for t, w in v.items()})
    vectors += vectors[:50]  # ties
    index = index_of(vectors, [0.0] * len(vectors), 60)
    for q in vectors[::29]:
        found = np.array(sorted(q))
        best, cosine = index.nearest(found, np.array([q[t] for t in found.tolist()]))
        every = sorted(((-sum(w * v.get(t, 0.0) for t, w in q.items()), e) for e, v in enumerate(vectors)))[: toxicity.NEIGHBOURS]
        assert np.allclose(cosine, [-s for s, _ in every])
        clear = [e for s, e in every if -s > cosine[-1] + 1e-9]
        assert set(clear) <= set(best.tolist())


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    found = [r for r in queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in truth]
    hit = sum(r["predicted"] and truth[r["doc_id"]] for r in found)
    assert hit >= 0.8 * sum(truth[r["doc_id"]] for r in found)
    assert hit >= 0.85 * sum(r["predicted"] for r in found)


def test_toxicity_odd_rows(spark, odd, make):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id bigint, toxic int")
    index = toxicity.fit(odd, labels)
    rows = toxicity.score_documents(odd, index).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score_documents(make([]), index).count() == 0
    unfitted = toxicity.fit(make([]), labels)
    assert {r["score"] for r in toxicity.score_documents(odd, unfitted).collect()} == {unfitted.empty_score}


@pytest.mark.parametrize("texts", [["you idiot"] * 30 + ["a fine day"] * 60])
def test_evidence_names_the_neighbours(spark, make, texts):
    docs = make([(i, t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in enumerate(texts)], "doc_id bigint, toxic int")
    index = toxicity.fit(docs, labels)
    row = {r["doc_id"]: r for r in toxicity.score_documents(docs, index).collect()}
    assert row[0]["predicted"] == 1 and row[50]["predicted"] == 0
    assert len(row[0]["neighbours"]) == toxicity.NEIGHBOURS and all(x["toxic"] == 1 and x["id"] < 30 for x in row[0]["neighbours"])


def test_every_example_and_term_is_compared(spark, make):
    texts = ["the scum came home late", "that trash spoke at length", "the train came home late", "a long speech was held", "rain fell over the hills", "", "the scum came home late"]
    docs = make(list(enumerate(texts)))
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)], "doc_id bigint, toxic int")
    index = toxicity.fit(docs, labels)
    assert index.ids == [0, 1, 2, 3, 4] and len(index.terms) == len({w for t in texts for w in t.split()})
    row = {r["doc_id"]: r["neighbours"] for r in toxicity.score_documents(docs, index).collect()}
    for i in (0, 1, 2, 3, 4):
        assert row[i][0]["id"] == i and math.isclose(row[i][0]["cosine"], 1.0) and row[i][0]["toxic"] == (i < 2)
    assert row[6] == row[0] and row[5] == []

    df = Counter(w for t in texts[:5] for w in set(t.split()))
    df1 = Counter(w for t in texts[:2] for w in set(t.split()))
    weight = lambda w: math.log(1 + 6 / df[w]) * math.log2(2 + df1[w] / max(df[w] - df1[w], 1))
    size = lambda t: math.sqrt(sum(weight(w) ** 2 for w in t.split()))
    cosine = lambda a, b: sum(weight(w) ** 2 for w in set(a.split()) & set(b.split())) / size(a) / size(b)
    want = {e: cosine(texts[0], texts[e]) for e in range(5) if set(texts[0].split()) & set(texts[e].split())}
    assert {x["id"]: round(x["cosine"], 9) for x in row[0]} == {e: round(c, 9) for e, c in want.items()}


def test_frequent_and_rare_terms_give_one_cosine(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.zipf(1.3, 40) % 3_000).astype(np.uint64) for _ in range(1_500)]
    sizes, flat = np.array([len(r) for r in rows]), np.concatenate(rows)
    found = []
    for dense in (0, 7, 512):
        monkeypatch.setattr(toxicity, "DENSE_TERMS", dense)
        index = toxicity.build_index(list(range(len(rows))), np.arange(len(rows)) % 9 == 0, sizes, flat, np.ones(len(flat)))
        found.append(index.nearest_many([index.vector(r) for r in rows[::50]]))
    for a, b, c in zip(*found):
        assert a[0].tolist() == b[0].tolist() == c[0].tolist() and np.allclose(a[1], b[1]) and np.allclose(a[1], c[1])
