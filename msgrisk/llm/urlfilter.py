"""Operator 3: URL rules by a sort-merge range join on reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from msgrisk.llm.common import column, in_ranges

DEFAULT = "allow"  # the verdict where no rule fits

# The production rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

END = "\x00"  # closes the host part of a key; sorts before all else


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.substring_index(F.substr(url, F.locate("://", url) + 3), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(F.contains(url, F.lit("://")), _lower(host)).otherwise(F.lit(""))


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substr(url, F.locate("://", url) + 3)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return F.when(
        F.contains(url, F.lit("://")), F.substr(rest, F.length(host) + 1)
    ).otherwise(F.lit(""))


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


@dataclass(frozen=True)
class Sizes:
    """What the rules look like: numbers of labels, lengths of keys, the longest path.

    Each list has no number twice, so neither is longer than the longest rule.
    """

    labels: list[int]
    keys: list[int]
    path: int

    @classmethod
    def of(cls, rule_keys: DataFrame) -> Sizes:
        found = rule_keys.agg(
            F.collect_set(F.size(F.split("host", "\\."))), F.collect_set(F.length("key")),
            F.coalesce(F.max(F.length("path")), F.lit(0)),
        ).first()
        return cls(sorted(found[0]), sorted(found[1]), found[2])


def _numbers(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def _url_keys(urls: DataFrame, sizes: Sizes) -> DataFrame:
    """A key for each domain that a host belongs to, itself included, if rules have such.

    ``a.b.org`` with a path gives ``org``, ``org.b`` and ``org.b.a``, each with the
    path behind it, so that a rule fits exactly if its key begins one of them. Domains
    of as many labels as no rule's host has are left out, and a key has no more of the
    path than the longest path of a rule, so keys stay short however long a URL is.
    """
    labels = urls.where("host != ''").select("host", "path", F.reverse(F.split("host", "\\.")).alias("l"))
    depth = F.explode(F.filter(_numbers(sizes.labels), lambda n: n <= F.size("l"))).alias("n")
    domain = F.array_join(F.slice("l", F.lit(1), F.col("n")), ".")
    return labels.select("host", "path", "l", depth).select(
        F.concat(domain, F.lit(END), F.substr("path", F.lit(1), F.lit(sizes.path))).alias("key"),
        F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"),
    )


def _rule_keys(rules: DataFrame) -> DataFrame:
    clean = rules.select(
        _lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host is not null and host != '' and verdict is not null")
    # Of the same rule given twice, blocking wins.
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return clean.select(
        F.concat(_reversed(F.col("host")), F.lit(END), "path").alias("key"),
        F.lit(0).alias("kind"), "host", "path", "verdict",
    )


FOUND = StructType([StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")])


def _sweep(carried: dict[int, list[tuple[str, str, str]]]):
    """Walk through sorted keys with a stack of the rules whose intervals are open.

    A rule's interval holds the keys that begin with its own key. Sorted, a rule
    comes before all of them, and intervals are nested or disjoint. ``carried`` has
    the rules that are open where a range begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = [], None
        for batch in batches:
            out = {n: [] for n in FOUND.names}
            rows = zip(*(column(batch, n) for n in ("part", "key", "kind", "host", "path", "verdict")))
            for part, key, kind, host, path, verdict in rows:
                if part != at:
                    stack, at = list(carried.get(part, [])), part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, host + path, verdict))
                elif stack:
                    for n, v in zip(FOUND.names, (host, path, stack[-1][1], stack[-1][2])):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string()) for n, v in out.items()})

    return run


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)``: the longest rule that fits, for distinct URLs.

    Rules and URL keys are sorted together by range, so both may be of any size and
    no key has to fit into one task. Only what is open at the edges of the ranges is
    looked up apart: for the first key of each range, the rules that begin it.
    """
    rule_keys = _rule_keys(rules)
    sizes = Sizes.of(rule_keys)
    keys = _url_keys(urls, sizes).unionByName(rule_keys)
    order = ["key", "kind", "host", "path"]
    ranges = in_ranges(keys, order, "url-ranges").drop("at")
    firsts = ranges.groupBy("part").agg(F.min("key").alias("first"))
    lengths = F.filter(_numbers(sizes.keys), lambda n: n <= F.length("first"))
    begun = firsts.select(
        "part", F.explode(F.transform(lengths, lambda n: F.substr("first", F.lit(1), n))).alias("key")
    )
    open_ = begun.join(ranges.where("kind = 0").withColumnRenamed("part", "own"), "key")
    # As many rows as there are ranges, times how deep rules are nested.
    carried: dict[int, list[tuple[str, str, str]]] = {}
    for r in open_.select("part", "own", "key", F.concat("host", "path").alias("rule"), "verdict").collect():
        if r["own"] != r["part"]:
            carried.setdefault(r["part"], []).append((r["key"], r["rule"], r["verdict"]))
    for rules_open in carried.values():
        rules_open.sort()
    again = ranges.repartition("part").sortWithinPartitions("part", *order)
    return again.mapInArrow(_sweep(carried), FOUND)


def judged(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
    default: str = DEFAULT,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for each row.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path``. A rule fits its
    host and all subdomains if the path starts with the rule's; of those that fit the
    one with the longest host and path wins, and blocking wins between equals. No
    rule, no host, a null URL and one without ``://`` get the default verdict and a
    null rule. Ids may be null or repeat; rows with the same URL are judged once. The
    work grows with the length of a URL, not with its square.
    """
    rows = pages.select(
        F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"),
        path_of(F.col(url_column)).alias("path"),
    )
    urls = rows.select("host", "path").distinct()
    # A host has one match for each of its domains at most.
    longest = F.max(F.struct(F.length("rule"), F.col("verdict") == "block", "rule", "verdict")).alias("best")
    best = matches(urls, rules).groupBy("host", "path").agg(longest)
    joined = rows.join(best, ["host", "path"], "left")
    return joined.select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
