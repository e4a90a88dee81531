"""Encoding against the tokenizers library, and the round trip."""

from __future__ import annotations

import os
import random

import pytest

from tidegrid.llm import encoding

TEXTS = [
    "The feed is late. We will not wait,",
    "it's we'll they've  two  spaces\n\n\ttabs \r\n end  ",
    "12345 abc123 v2.3.4 $%&*() ... ?!",
    "<|endoftext|> is ordinary text",
    "数据迟到了。不能再等。 データが遅れている ข้อมูลมาช้า صحّح रात्रि",
    "é é   ​   ﻿ x",
    "🚨📈⚠️ emoji👩‍👩‍👧",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    " ",
    "\n",
    "",
    None,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, word string, ids string")


def test_ids_equal_the_library(spark, reference):
    rng = random.Random(9)
    alphabet = "abcdeABC012 .,'\né中ก"
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(80)), "x" * 5000, "".join(rng.choice("abcdefghijklmnop") for _ in range(1500))]
    got = {r.doc_id: r.ids for r in encoding.encode(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == reference(t), t


@pytest.mark.parametrize("room", [0, 600, 3000])
def test_words_beyond_the_book_are_folded_in_their_row(spark, reference, monkeypatch, room):
    monkeypatch.setattr(encoding, "BOOK_BYTES", room)
    df = frame(spark, [*TEXTS, TEXTS[0], "w" * 300])
    got = {r.doc_id: r.ids for r in encoding.encode(df).collect()}
    counts = {r.doc_id: r.tokens for r in encoding.token_counts(df).collect()}
    for i, t in enumerate([*TEXTS, TEXTS[0], "w" * 300]):
        assert got[i] == reference(t) and counts[i] == len(got[i])


def test_the_book_keeps_its_bound(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    df = frame(spark, [" ".join(words), " ".join(words[:20]), " ".join(words[:20])])
    monkeypatch.setattr(encoding, "BOOK_BYTES", 40 * (encoding.ENTRY_BYTES + 5 * 4))
    kept = {r.word for r in encoding.book_words(df, "text").collect()}
    assert " w" in kept and sum(encoding.ENTRY_BYTES + 5 * len(w) for w in kept) <= encoding.BOOK_BYTES


def test_no_merge_enables_a_pair_of_lower_rank():
    """Merging all occurrences of a pair at once is the one-by-one order if each token is built by merges of rising rank."""
    ranks = {bytes.fromhex(piece): rank for piece, rank in encoding.ranks(os.path.join(encoding.TOKENIZERS, encoding.VOCABULARY))}
    for token in ranks:
        parts, before = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], encoding.NO_RANK), i) for i in range(len(parts) - 1))
            assert before <= rank < encoding.NO_RANK, token
            before = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_round_trip_and_counts(spark, reference):
    df = frame(spark, TEXTS)
    ids = encoding.encode(df)
    back = {r.doc_id: r.text for r in encoding.decode(ids).collect()}
    counts = {r.doc_id: r.tokens for r in encoding.token_counts(df).collect()}
    for i, t in enumerate(TEXTS):
        assert back[i] == (t or "") and counts[i] == len(reference(t))
    bad = spark.createDataFrame([(1, [99999999])], "doc_id bigint, ids array<int>")
    assert encoding.decode(bad).first().text is None


def test_repeated_and_no_rows(spark):
    assert encoding.encode(frame(spark, [])).count() == 0
    rows = encoding.encode(frame(spark, ["same text"] * 50)).collect()
    assert len(rows) == 50 and len({tuple(r.ids) for r in rows}) == 1
    twice = spark.createDataFrame([(1, "one text"), (1, "one text"), (1, "another"), (None, "one text"), (2, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, len(r.ids)) for r in encoding.encode(twice).collect())
    assert got == [(0, 2), (1, 1), (1, 2), (1, 2), (2, 0)]
