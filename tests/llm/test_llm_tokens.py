"""Encoding against the tokenizers library, whole and in pieces."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from msgrisk.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "b", "ab", " ", "  ", "\n", "'", "'s", "ll", "é", "日", "1", "!", "\xa0", "\x1c", "\x00",
    "e\u0301", "İ", "Σ", "the", "😀", "²", "\u2003", "\t ",
]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.booleans())
def test_whole_texts(library, text, special):
    text += "<|endoftext|> x" if special else ""
    found = tokens.encoder(PATH).encode(text)
    assert np.frombuffer(found, "<u4").tolist() == ids_of(library, text)
    assert tokens.encoder(PATH).decode(found).decode() == text


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words(text):
    library = Tokenizer.from_file(WORDS) if not hasattr(test_words, "kept") else test_words.kept
    test_words.kept = library
    coder = test_words.coder = getattr(test_words, "coder", None) or bpe.WordBpe(WORDS)
    want = bpe.packed(ids_of(library, text))
    assert coder.encode(text) == want
    assert coder.encode_batch(["a b", text, ""]) == [coder.encode("a b"), want, b""]


@pytest.mark.parametrize("leaf", [6, 40])
@settings(max_examples=300, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 60), max_size=6))
def test_tree_of_pieces_cut_anywhere(library, leaf, text, cuts):
    coder, kept = tokens.encoder(PATH), bpe.LEAF
    bpe.LEAF = leaf
    try:
        cuts = sorted(min(c, len(text)) for c in cuts)
        parts = [coder.part(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        whole = coder.tree(parts)
    finally:
        bpe.LEAF = kept
    assert whole.text == text and whole.ids.tolist() == ids_of(library, text)
    assert whole.ends.tolist() == coder.splits(text).tolist()


@pytest.mark.parametrize("run", ["a" * 50_000, "ab" * 20_000, " " * 30_000, "日本" * 9000, "!?" * 9000])
def test_long_unsplit_runs(library, run):
    coder = tokens.encoder(PATH)
    parts = [coder.part(run[i : i + 7001]) for i in range(0, len(run), 7001)]
    assert coder.tree(parts).ids.tolist() == ids_of(library, run)


def test_table(spark, library):
    long = "word's  \n" * 500 + "z" * 900
    texts = [None, "", "x", long, long, "<|endoftext|>" + long, "\n\n  ", "ab" * 700]
    rows = [(None if i == 3 else i % 6, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = tokens.digests(tokens.encode(docs, PATH, split=64), PATH).collect()
    want = []
    for i, text, _ in rows:
        ids = bpe.packed(ids_of(library, text or ""))
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    decoded = tokens.decode(tokens.encode(docs, PATH), PATH).collect()
    assert sorted(r["decoded"] for r in decoded) == sorted(t or "" for t in texts)
    assert tokens.encode(docs.limit(0), PATH).count() == 0
