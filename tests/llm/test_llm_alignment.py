"""Alignment of two tokenizers against walking both token lists."""

import hashlib
from collections import Counter

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from msgrisk.llm import alignment, bpe, queries

PATHS = tuple(public_tokenizers.path(n) for n in (queries.BYTE_VOCABULARY, queries.PIECE_VOCABULARY))


def tokens(text, byte_side, piece_side):
    """Both lists of (id, bytes); empty where one does not give the text back."""
    if not text:
        return [], []
    alphabet = bpe.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in byte_side.id_to_token(i)))
         for i in byte_side.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in piece_side.encode(text):
        piece = piece_side.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if piece_side.is_byte(i) else piece.replace("▁", " ").encode()
        b.append((i, raw))
    want = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == want for side in (a, b)) else ([], [])


def brute(docs):
    byte_side = Tokenizer.from_file(PATHS[0])
    byte_side.encode_special_tokens = True
    piece_side = SentencePieceProcessor(model_file=PATHS[1])
    rows, holders = [], Counter()
    for i, text in docs:
        a, b = tokens(text, byte_side, piece_side)
        x = y = end_a = end_b = 0
        links, groups, mine = Counter(), [], ([], [])
        while x < len(a):
            links[a[x][0], b[y][0]] += 1
            stop_a, stop_b = end_a + len(a[x][1]), end_b + len(b[y][1])
            if stop_a <= stop_b:
                mine[0].append(str(a[x][0]))
            if stop_b <= stop_a:
                mine[1].append(str(b[y][0]))
            if stop_a == stop_b:
                groups.append("|".join(map(",".join, mine)))
                mine = ([], [])
            x, end_a, y, end_b = (
                *((x + 1, stop_a) if stop_a <= stop_b else (x, end_a)),
                *((y + 1, stop_b) if stop_b <= stop_a else (y, end_b)),
            )
        holders.update(links.keys())
        rows.append((i, len(a), len(b), groups, links))
    most = Counter()
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for i, n_a, n_b, groups, links in rows:
        best = sum(n for p, n in links.items() if holders[p] == most[p[0]])
        total = sum(n * holders[p] for p, n in links.items())
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((i, n_a, n_b, len(groups), sum(links.values()), best, total, digest))
    return out, holders


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = queries.op13_alignment(spark, sf_dir)
    assert sorted(tuple(r[n] for n in ("doc_id", *NAMES)) for r in found.collect()) == sorted(want)


def test_odd_rows(spark, tmp_path, monkeypatch):
    texts = [None, "", " ", "  two  spaces \n\n\ttabs", "a<|endoftext|>b <s></s><unk> <0x41>", "▁x", " 　",
             "nul\x00byte \x7f​", "é ﬁ ① \U0001f469‍\U0001f4bb \U0001d11e", "w" * 60_000, "Zwei Wörter, 12,5 %! " * 3_000,
             "copy of a text", "copy of a text", "日本語のテキスト"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "y", 2), (4, "repeated id", "y", 3)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, block string, docs int").write.parquet(path)
    docs = spark.read.parquet(path)
    monkeypatch.setattr(alignment, "BLOCK", 50)
    monkeypatch.setattr(alignment, "PART", 200)
    found, pairs = alignment.align(docs.coalesce(1), *PATHS, with_groups=True)
    want, holders = brute([r[:2] for r in rows])
    got = found.collect()
    assert sorted(map(repr, (tuple(r[n] for n in ("id", *NAMES)) for r in got))) == sorted(map(repr, want))
    assert {(r["a"], r["b"]): r["docs"] for r in pairs.collect()} == dict(holders)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])
    empty, no_pairs = alignment.align(docs.limit(0), *PATHS)
    assert empty.count() == 0 and no_pairs.count() == 0
