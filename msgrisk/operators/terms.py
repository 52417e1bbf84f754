"""Lexicons that are tables: terms of a DataFrame looked up in texts in one pass.

``functions.lexicon`` tests each term of a small lexicon by itself, inside the plan. Here
a text goes once through an Aho-Corasick automaton of all terms, so the time hardly
depends on their number, and neither does the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from msgrisk.session import scratch_path

CHARACTERS = 2_000_000  # of the terms in one automaton

MATCH = StructType([
    StructField("group", StringType()), StructField("term", StringType()),
    StructField("weight", LongType()),
])

Entry = tuple[str, str, int]  # as in MATCH
Keyed = tuple[str, Entry]  # the term in lower case, and the entry


def lexicon_table(
    terms: DataFrame, term: str = "term", group: str | None = "group", weight: str | None = None,
    rank: str | None = None,
) -> DataFrame:
    """``(_lower, group, term, weight, _rank)``: the entries of a lexicon, once each.

    Entries without a term are left out. Without a ``rank`` they go by group and term.
    """
    columns = {
        "_lower": F.lower(term),
        "group": F.col(group).cast("string") if group else F.lit(None).cast("string"),
        "term": F.col(term),
        "weight": F.coalesce(F.col(weight).cast("bigint"), F.lit(1)) if weight else F.lit(1).cast("bigint"),
        "_rank": F.col(rank).cast("double") if rank else F.lit(0).cast("double"),
    }
    rows = terms.filter(F.col(term).isNotNull()).select(*[c.alias(n) for n, c in columns.items()])
    keys = ["_lower", "group", "term"]
    return rows.groupBy(*keys).agg(F.max("weight").alias("weight"), F.min("_rank").alias("_rank"))


class Finder:
    """All terms that occur in a text, by one walk through the text."""

    def __init__(self, entries: list[Keyed]):
        import ahocorasick

        kind = pa.struct(list(to_arrow_schema(MATCH)))
        self.entries = pa.array([dict(zip(MATCH.names, e)) for _, e in entries], kind)
        of_term: dict[str, list[int]] = {}
        for i, (lower, _) in enumerate(entries):
            of_term.setdefault(lower, []).append(i)
        self.always = of_term.pop("", [])
        self.rows = list(of_term.values())
        self.automaton = ahocorasick.Automaton()
        for i, lower in enumerate(of_term):
            self.automaton.add_word(lower, i)
        if self.rows:
            self.automaton.make_automaton()

    def numbers(self, lowered: str | None) -> list[int]:
        """Numbers of the entries whose terms a text in lower case has, ascending."""
        if lowered is None:
            return []
        found = {i for _, i in self.automaton.iter(lowered)} if self.rows else ()
        return sorted([*self.always, *(n for i in found for n in self.rows[i])])

    def matches(self, lowered: list[str | None]) -> pa.ListArray:
        numbers = [self.numbers(t) for t in lowered]
        ends = np.append(0, np.cumsum([len(n) for n in numbers], dtype=np.int64)).astype(np.int32)
        flat = pa.array([i for n in numbers for i in n], pa.int64())
        return pa.ListArray.from_arrays(pa.array(ends), self.entries.take(flat))


def with_terms(
    df: DataFrame, text: Column | str, lexicon: DataFrame, name: str = "matches",
    characters: int = CHARACTERS,
) -> DataFrame:
    """Add the entries of a ``lexicon_table`` whose terms occur in the text, case aside.

    ``matches`` is an array of ``MATCH`` in the order of rank, group and term, each entry
    once; empty for a null text. An empty term occurs in every text. The size of the
    lexicon is counted first. Up to ``characters`` characters of terms go to the tasks as
    one automaton, and rows stay where they are. A larger lexicon is looked up in parts
    of that size: the texts are written once below the shared folder, read by each part,
    and only matches are shuffled.
    """
    lexicon = lexicon.select("_lower", *MATCH.names, "_rank")
    total, count = lexicon.agg(F.coalesce(F.sum(F.length("_lower") + 1), F.lit(0)), F.count("*")).first()
    lowered = F.lower(F.col(text) if isinstance(text, str) else text).alias("_lowered")
    if total <= characters or count <= 1:
        return _looked_up(df.select("*", lowered), _entries(lexicon), name).drop("_lowered")
    path = scratch_path(df.sparkSession, "texts")
    numbered = df.select("*", lowered, F.monotonically_increasing_id().alias("_row"))
    numbered.write.parquet(path)
    rows = df.sparkSession.read.schema(numbered.schema).parquet(path)
    # Hashes deal the terms out unevenly, so parts are planned at half the size.
    parts = -(-2 * total // characters)
    part = F.pmod(F.xxhash64("_lower"), F.lit(parts))
    found = None
    for i in range(parts):
        entries = _entries(lexicon.filter(part == i))
        if not entries:
            continue
        some = _looked_up(rows.select("_row", "_lowered"), entries, "_some")
        some = some.select("_row", F.explode("_some").alias("_match"))
        found = some if found is None else found.unionByName(some)
    ranks = lexicon.select(F.struct(*MATCH.names).alias("_match"), "_rank")
    ranked = found.join(ranks, "_match")
    order = F.struct("_rank", *[F.col(f"_match.{n}") for n in ("group", "term")], "_match")
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda m: m["_match"])
    per_row = ranked.groupBy("_row").agg(listed.alias(name))
    joined = rows.drop("_lowered").join(per_row, "_row", "left").drop("_row")
    none = F.array().cast(ArrayType(MATCH))
    return joined.withColumn(name, F.coalesce(name, none))


def _entries(lexicon: DataFrame) -> list[Keyed]:
    """Entries in order; the caller has made sure that they are few enough."""
    rows = lexicon.orderBy("_rank", F.col("group").asc_nulls_first(), "term").collect()
    return [(r["_lower"], (r["group"], r["term"], r["weight"])) for r in rows]


def _looked_up(df: DataFrame, entries: list[Keyed], name: str) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(MATCH))])
    shared = df.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, target = Finder(shared.value), to_arrow_schema(schema)
        for batch in batches:
            lowered = batch.column(batch.schema.get_field_index("_lowered")).to_pylist()
            found = finder.matches(lowered).cast(target.field(name).type)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=target.names)

    return df.mapInArrow(run, schema)


def terms_of(matches: Column) -> Column:
    """The matched terms as one list, in order."""
    return F.transform(matches, lambda m: m["term"])


def terms_in(matches: Column, group: str) -> Column:
    """The matched terms of one group."""
    return F.transform(F.filter(matches, lambda m: m["group"] == group), lambda m: m["term"])


def weight_of(matches: Column) -> Column:
    """Sum of the weights of what matched."""
    return F.aggregate(matches, F.lit(0).cast("bigint"), lambda total, m: total + m["weight"])


def leading_group(matches: Column) -> Column:
    """Struct ``(group, hits)`` of the group with most entries, the first by name of equals."""
    groups = F.array_distinct(F.transform(matches, lambda m: m["group"]))

    def count(group: Column) -> Column:
        hits = F.size(F.filter(matches, lambda m: m["group"].eqNullSafe(group)))
        return F.struct((-hits).alias("rank"), group.alias("group"), hits.alias("hits"))

    best = F.array_min(F.transform(groups, count))
    return F.struct(best["group"].alias("group"), F.coalesce(best["hits"], F.lit(0)).alias("hits"))
