"""The registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest
from test_llm_groups import print_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from msgrisk.llm import packing, quality, queries, simhash, toxicity
from msgrisk.llm.classify import Rows


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name) is None


def test_all_operators_are_registered():
    names = [n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def near(docs):
    """One document of each group of fingerprints, by comparing all pairs."""
    prints, kept, left = {i: simhash.fingerprint(t) for i, t in docs}, [], dict(docs)
    while left:
        group, queue = [], [min(left)]
        left.pop(queue[0])
        while queue:
            x = queue.pop()
            group.append(x)
            close = [y for y in left if (prints[x] ^ prints[y]).bit_count() <= 3]
            for y in close:
                left.pop(y)
            queue += close
        kept.append(min(group))
    return [(i, t) for i, t in docs if i in set(kept)]


def test_pipeline_equals_brute_force(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    steps = [len(docs)]

    model, make = toxicity.train(table, labels), toxicity.extractor()
    score = model.scores(Rows.of([make(t or "") for _, t in docs]))
    docs = [d for d, s in zip(docs, score) if s < 0.3]
    steps.append(len(docs))
    left = table.where(table["doc_id"].isin([i for i, _ in docs]))
    model, make = quality.train(left, labels), quality.extractor()
    score = model.scores(Rows.of([make(t or "") for _, t in docs]))
    docs = [d for d, s in zip(docs, score) if s >= 0.3]
    steps.append(len(docs))
    first = {}
    for i, text in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i)
    docs = near([(i, t) for i, t in docs if i in set(first.values())])
    steps.append(len(docs))
    coder, want = packing.WordBpe(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in docs:
        n = len(coder.encode(text or "")) // 4 + 1
        want += [(i, p, a, min(2048, n - a)) for p, a in enumerate(range(0, n, 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in found) == sorted(want)
    assert all(a >= b for a, b in zip(steps, steps[1:])) and steps[0] > steps[-1]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, sf_dir, tmp_path, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "w " * 60_000, "en", "a", 9),
            (2, "w " * 60_000, "en", "a", 9), (3, "fine words stand here", None, "a", 3)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("some", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(some, columns).write.parquet(path)
        docs = spark.read.parquet(path)
        made = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
        assert made.count() <= 100 and (some or made.count() == 0)
        if stage < 4:
            assert made.columns == docs.columns


def texts_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def library(name):
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.no_truncation()
    made.no_padding()
    return made


def test_bpe_query_equals_the_library(spark, sf_dir):
    coder, want = library(queries.BYTE_VOCABULARY), []
    for i, text in texts_of(spark, sf_dir).items():
        ids = coder.encode(text, add_special_tokens=False).ids
        back = coder.decode(ids, skip_special_tokens=False).encode()
        digests = (hashlib.sha256(x).hexdigest() for x in (struct.pack(f"<{len(ids)}I", *ids), back))
        want.append((i, len(ids), *digests))
    found = queries.op1_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_simhash_query_equals_all_pairs(spark, sf_dir):
    prints = {i: print_of(t) for i, t in texts_of(spark, sf_dir).items()}
    root = {}
    for i in sorted(prints):  # the smallest id of a group opens it
        queue = [] if i in root else [i]
        while queue:
            x = queue.pop()
            if x not in root:
                root[x] = i
                queue += [y for y in prints if (prints[x] ^ prints[y]).bit_count() <= 3]
    want = [(i, f"{p:016x}", root[i]) for i, p in prints.items()]
    assert sorted(map(tuple, queries.op4_simhash(spark, sf_dir).collect())) == sorted(want)


def test_packing_query_holds_its_contract(spark, sf_dir):
    coder, want = library(queries.WORD_VOCABULARY), []
    for i, text in texts_of(spark, sf_dir).items():
        ids = [*coder.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    found = queries.op7_packing(spark, sf_dir)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for sequence in places.values():
        ends = [0]
        for offset, length in sorted(sequence):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1
