"""Token counts and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fairspark.llm import packing, token_counts
from fairspark.llm.queries import tokenizer_path
from fairspark.llm.tables import table

SF = "/root/testdata/sf0.001"
PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")


def noisy(signs, n=150, longest=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    pieces, words = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    return (
        lambda t: len(pieces.encode(t or "", num_threads=1)),
        lambda t: words.encode(t or "", add_special_tokens=False).ids + [2],
    )


def test_piece_counts_equal_the_library(library):
    texts = noisy("ab =-_\n.é日\U0001f600the ing▁<s>") + ["", " ", "  a  b", "=" * 700, " " * 400 + "x", "a" * 600, "a\x00b", "▁▁x y"]
    got = token_counts.piece_ranks(PIECES).count_texts(pa.array(texts))
    assert got.tolist() == [library[0](t) for t in texts]


def test_word_ids_equal_the_library(library):
    texts = noisy("ab'sldvremt =-_\n.é日\U0001f600́Ⅳ1٣ TheİΣ |<>") + ["", None, "it's Tom'S <|endoftext|> a", "x<|ENDOFTEXT|>"]
    ids, at = packing.WordIds(WORDS, 2).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library[1](t) for t in texts]


def test_words_are_forgotten_without_harm(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.WordIds(WORDS, 2)
    for t in ("a b c d e f g h", "h g f e d c", "i j k a b c"):
        assert words.encode(pa.array([t]))[0].tolist() == library[1](t)


def cheapest(position, penalty, width):
    """Quadratic version of the dynamic program with a closed end."""
    at = [0, *position]
    best = [0.0] + [float("inf")] * len(position)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= width:
                best[j] = min(best[j], best[i] + width - (at[j] - at[i]) + penalty[j - 1])
    return best


def test_window_cuts_cost_the_least():
    rng = random.Random(5)
    for _ in range(60):
        steps = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        position = np.cumsum(steps).tolist()
        penalty = [rng.choice([0, 8, 48]) for _ in position]
        cuts = packing.window_cuts(position, penalty, 64, last=False)
        at = [0, *position]
        best = cheapest(position, penalty, 64)
        where = {p: k for k, p in enumerate(at)}
        cost = sum(64 - (b - a) + penalty[where[b] - 1] for a, b in zip([0, *cuts[:-1]], cuts))
        assert all(0 < b - a <= 64 for a, b in zip([0, *cuts], cuts))
        if cuts:
            assert cost == best[where[cuts[-1]]]
        closed = packing.window_cuts(position, penalty, 64, last=True)
        assert closed[-1] == position[-1] and all(0 < b - a <= 64 for a, b in zip([0, *closed], closed))


def rebuilt(pieces, library, texts):
    """Every id once, in order, and no gap in a sequence."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in texts.items():
        ids = [x for p in sorted(by_doc[doc], key=lambda p: p["start"]) for x in p["ids"]]
        assert ids == library[1](text)
        assert {p["doc_tokens"] for p in by_doc[doc]} == {len(ids)}
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) > 0
            at += p["length"]
        assert at <= 4096
    return [sum(p["length"] for p in x) for x in by_sequence.values()]


def test_packing_round_trip(spark, library):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = rebuilt(packing.pack(docs, WORDS).collect(), library, texts)
    padding = sum(4096 - n for n in sizes if n & (n - 1))
    assert padding < 0.01 * sum(sizes)


def test_streams_carry_their_rest(spark, library, monkeypatch):
    words, texts = packing.word_ids(WORDS, 2), {i: "some words. " * (40 * i) for i in range(1, 60)}
    stream, pieces = packing.Stream(words, 4096, 0), []
    for i, t in texts.items():
        stream.add([i], *words.encode(pa.array([t])))
        if stream.held > 20_000:
            pieces.append(stream.pack(last=False))
    pieces.append(stream.pack(last=True))
    rows = []
    for p in pieces:
        raw, at = p["ids"]
        rows += [
            dict(doc_id=p["id"][k], start=int(p["start"][k]), length=int(p["length"][k]), ids=raw[at[k] : at[k + 1]].tolist(), doc_tokens=int(p["doc_tokens"][k]), sequence_id=int(p["sequence_id"][k]), offset=int(p["offset"][k]))
            for k in range(len(p["id"]))
        ]
    rebuilt(rows, library, texts)


def test_packing_odd_rows(odd, library):
    rows = packing.pack(odd, WORDS, digest=True).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sum(r["length"] for r in rows) == sum(len(library[1](t)) for _, t in texts)
    whole = {r["doc_id"]: r["ids_crc32"] for r in rows if r["length"] == r["doc_tokens"]}
    for doc, text in texts:
        if doc in whole:
            assert whole[doc] == zlib.crc32(np.array(library[1](text), "<u4").tobytes())


def test_counts_odd_rows(odd, library):
    rows = token_counts.count_tokens(odd, PIECES).collect()
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    texts = [(r["doc_id"] or 0, r["text"] or "") for r in odd.collect()]
    assert got == sorted((d, len(t.encode()), n := library[0](t), n > 4096) for d, t in texts)


def test_empty_tables(make):
    assert token_counts.count_tokens(make([]), PIECES).count() == 0
    assert packing.pack(make([]), WORDS).count() == 0
