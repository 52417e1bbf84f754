"""Exact and near deduplication against brute force."""

import random
import re

import pytest
import xxhash

from msgrisk.llm import dedup, simhash
from msgrisk.llm.common import stored


def fixture_rows():
    texts = [None, "", " \t", "a  b", "a b", "a\tb ", "a b ", "c" * 100_000, "c" * 100_000, "A b", "é\xa0b"]
    rows = [(i + 5, t, i, "x") for i, t in enumerate(texts)]
    return rows + [(None, "a b", 0, "x"), (None, "only", 0, "x"), (5, None, 9, "x"), (8, "a  b", 1, "y")]


def docs_of(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, row int, kept string").write.parquet(path)
    return spark.read.parquet(path)


def test_exact_groups(spark, tmp_path):
    docs = docs_of(spark, tmp_path, fixture_rows())
    groups = {}
    for i, text, *_ in fixture_rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    found = dedup.exact_groups(docs).collect()
    assert len(found) == len(fixture_rows())
    for ids in groups.values():
        real = [i for i in ids if i is not None]
        mine = [r for r in found if r["keep_id"] == (min(real) if real else None)]
        assert sorted(r["id"] or -1 for r in mine) == sorted(i or -1 for i in ids)
        assert {r["group_size"] for r in mine} == {len(ids)}
        assert sum(r["kept"] for r in mine) == 1 and len({r["text_sha256"] for r in mine}) == 1
    left = dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert dedup.exact_groups(docs.limit(0)).count() == 0


def test_runs_of_a_text_are_spread(spark):
    docs = spark.range(0, 2000, 1, 200).selectExpr("id AS doc_id", "'same' AS text")
    levels = dedup.merge_rounds(stored(dedup.digest_runs(docs), "runs"))
    assert [level.count() for level in levels] == [200, 4, 1]
    found = dedup.exact_groups(docs)
    assert found.where("keep_id = 0 AND group_size = 2000").count() == 2000
    assert found.where("kept").count() == 1


def print_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    left, out = set(prints), {}
    while left:
        queue, members = [left.pop()], []
        while queue:
            x = queue.pop()
            members.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            queue += near
        out.update(dict.fromkeys(members, min(members)))
    return out


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_masks_cover_each_three_bits(turn):
    masks = simhash.covering_masks(turn=turn)
    bits = range(64)
    assert len(masks) == 15
    for a in bits:
        for b in range(a):
            for c in range(b):
                assert any(not m & (1 << a | 1 << b | 1 << c) for m in masks)


@pytest.mark.parametrize("bucket", [2048, 4])
def test_links_connect_what_is_near(spark, monkeypatch, bucket):
    """Also with buckets so small that they are split again and again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    dice = random.Random(3)
    prints = set()
    for _ in range(12):
        x = dice.getrandbits(64)
        for _ in range(20):
            prints.add(x)
            for bit in dice.sample(range(64), dice.randint(1, 4)):
                x ^= 1 << bit
    signed = [simhash.signed(p) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    groups, want = {}, {}
    for p in prints:
        groups.setdefault(roots.get(simhash.signed(p), simhash.signed(p)), set()).add(p)
    for p, first in components_of(prints).items():
        want.setdefault(first, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_groups(spark, tmp_path):
    rows = fixture_rows()
    base = [f"w{i}" for i in range(300)]
    for i in range(12):
        words = base.copy()
        words[i * 20] = "other"
        rows.append((100 - i, " ".join(words), 0, "near"))
    docs = docs_of(spark, tmp_path, rows)
    found = simhash.near_groups(docs).collect()
    prints = [(i, print_of(t)) for i, t, *_ in rows]
    assert sorted((r["id"] or -1, r["fp"] & (1 << 64) - 1) for r in found) == sorted(
        (i or -1, p) for i, p in prints
    )
    roots = components_of({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    for r in found:
        assert r["component_id"] == least.get(roots[r["fp"] & (1 << 64) - 1])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))
    assert simhash.near_groups(docs.limit(0)).count() == 0
