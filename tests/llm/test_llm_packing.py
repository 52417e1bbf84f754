"""Packing: reduction against exact search, plans against their bounds."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from msgrisk.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[at] <= capacity}.values():
            bins[k] += items[at]
            go(at + 1, bins)
            bins[k] -= items[at]
        go(at + 1, [*bins, items[at]])

    go(0, [])
    return best[0]


def counted(items):
    return {x: items.count(x) for x in set(items)}


def test_reduction_keeps_a_best_packing():
    dice = random.Random(1)
    for _ in range(300):
        capacity = dice.randint(4, 30)
        items = [dice.randint(1, capacity) for _ in range(dice.randint(1, 9))]
        left = counted(items)
        fixed = packing.reduce_dominated(left, capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + fewest(rest, capacity) * bool(rest) == fewest(items, capacity)


def test_plans_hold_all_pieces_and_are_nearly_full():
    dice = random.Random(2)
    items = [min(2048, int(dice.lognormvariate(6, 1.2)) + 1) for _ in range(50_000)]
    plan = packing.plan(counted(items))
    packed = {}
    for times, pattern in plan:
        assert times > 0 and sum(length * n for length, n in pattern) <= 2048
        for length, n in pattern:
            packed[length] = packed.get(length, 0) + times * n
    assert packed == counted(items)
    assert sum(t for t, _ in plan) <= -(-sum(items) // 2048) * 1.001 + 2


def test_table(spark):
    texts = [None, "", "Hi there", "x y " * 3000, "word " * 2047, "same", "same", "Ünï日本 <|endoftext|>"] * 6
    rows = [(i // 2 if i else None, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = packing.packed(packing.pieces(docs, PATH, with_ids=True)).collect()
    library, want = Tokenizer.from_file(PATH), []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = bpe.packed(ids[at : at + 2048])
            want.append((i, piece, at, len(part) // 4, zlib.crc32(part)))
    keys = ("id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[k] for k in keys) for r in found), key=str) == sorted(want, key=str)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for stretch in places.values():
        at = 0
        for offset, length in sorted(stretch):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in found) // 2048) + 2
    assert packing.packed(packing.pieces(docs.limit(0), PATH)).count() == 0


def test_places_are_distinct():
    places = packing.Places([(3, ((5, 2), (4, 1))), (2, ((5, 1),))])
    sequence, offset = places.of(np.full(8, 5), np.arange(8))
    assert len(set(zip(sequence, offset))) == 8 and places.sequences == 5


def test_carried_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(30)], "doc_id long, text string")
    rows = packing.pieces(docs, PATH)
    more = {n: rows["id"] * k for k, n in enumerate(("part", "at", "shift", "rank", "carried", "a.b"), 2)}
    wide = rows.select("*", *[c.alias(n) for n, c in more.items()])
    found = packing.packed(wide)
    assert found.columns == [*wide.columns, "sequence_id", "offset"]
    for r in found.collect():
        assert [r[n] for n in more] == [r["id"] * k for k in range(2, 8)]
