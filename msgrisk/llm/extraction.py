"""Operator 10: main text of web pages by differencing pages with near URLs."""

from __future__ import annotations

import json
import os.path
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from msgrisk.llm.common import column, in_ranges, map_rows, row_key, stored
from msgrisk.llm.mainlines import AROUND, ARTICLE, FORM, FRAME, OTHER, Line, common_lines, lines_of
from msgrisk.llm.urlfilter import host_of, path_of


def signatures(pages: DataFrame, html_column: str, url_column: str) -> DataFrame:
    """Two light rows per page: where it sorts, and its lines outside a marked article.

    A page is placed once among all pages of its host by path, and once among those
    that begin with the same line, as a host may use many frames in turn. ``whole``
    tells pages of other lines apart.
    """
    rows = pages.select(
        row_key(F.col(url_column), F.col(html_column)).alias("row"), host_of(F.col(url_column)).alias("host"),
        path_of(F.col(url_column)).alias("path"), F.col(html_column).alias("html"),
    ).where("host != ''")
    schema = StructType([
        StructField("host", StringType()), StructField("anchor", LongType()),
        StructField("path", StringType()), StructField("row", BinaryType()),
        StructField("hashes", BinaryType()), StructField("zones", BinaryType()),
        StructField("sizes", BinaryType()), StructField("whole", BinaryType()),
    ])

    def make():
        def work(batch):
            out = {n: [] for n in schema.names}
            keys = zip(*(column(batch, n) for n in ("host", "path", "row")))
            for (host, path, row), page in zip(keys, column(batch, "html")):
                found = lines_of(page)
                lines = [x for x in found if x.zone != ARTICLE]
                if lines:
                    hashes = array("q", [xxhash.xxh64_intdigest(x.text) - 2**63 for x in lines])
                    # Beside a marked article, pages may have all other lines in common.
                    main = () if len(lines) < len(found) else main_zones(found)
                    zones = bytes(OTHER if x.zone in main else FRAME for x in lines)
                    sizes = array("q", [len(x.text) for x in lines])
                    each = "\n".join(f"{x.zone}{x.text}" for x in found)
                    rest = (hashes.tobytes(), zones, sizes.tobytes(), xxhash.xxh128_digest(each))
                    for anchor in (0, hashes[0]):
                        values = (host, anchor, path, row, *rest)
                        for n, v in zip(schema.names, values):
                            out[n].append(v)
            yield out

        return work

    return map_rows(rows, make, schema, 500).dropDuplicates(["row", "anchor"])


def main_zones(lines: list[Line]) -> tuple[int, ...]:
    """The zones of a page's main text: its marked articles and what is around them in <main>.

    Without these what is unmarked; if a form holds all the rest, what it holds.
    """
    marked = tuple(z for z in (ARTICLE, AROUND) if any(x.zone == z for x in lines))
    return marked or ((OTHER,) if any(x.zone == OTHER for x in lines) else (FORM,))


def shared_lines(page: dict, other: dict | None) -> tuple[list[int], bool] | None:
    """Numbers of the lines of ``page`` that ``other`` has too, in the same order.

    And whether these hold most of the text that may be the main one, as in a large frame
    or in copies with few changes. None if the two are no pair: not of the same host and
    placing, or with all such text in common, which tells of copies and not of a frame.
    """
    if other is None or (page["host"], page["anchor"]) != (other["host"], other["anchor"]):
        return None
    shared = common_lines(*(array("q", x["hashes"]).tolist() for x in (page, other)))
    sizes, zones = array("q", page["sizes"]), page["zones"]
    total = sum(n for n, z in zip(sizes, zones) if z == OTHER)
    common = sum(sizes[i] for i in shared if zones[i] == OTHER)
    return None if total and common == total else (shared, 2 * common > total)


def _nearness(page: dict, other: dict | None) -> int:
    return len(os.path.commonprefix([page["path"], other["path"]])) if other else -1


def template_lines(before: dict | None, page: dict, after: dict | None) -> list[int]:
    """Lines to delete, by the neighbour whose path is nearest and makes a pair.

    Where those hold most of the text, the other neighbour must have them too, if it makes
    a pair: a frame is on all pages, the text of a copy with few changes is not.
    """
    pairs = [before, after] if _nearness(page, before) >= _nearness(page, after) else [after, before]
    found = [x for x in (shared_lines(page, other) for other in pairs) if x is not None]
    if len(found) == 2 and found[0][1]:
        other = set(found[1][0])
        return [i for i in found[0][0] if i in other]
    return found[0][0] if found else []


def differences(signed: DataFrame) -> DataFrame:
    """``(row, shared)``: the lines outside its article that a page's pairs have too.

    Of pages of a host that have all lines in common one is sorted, so that the page
    beside it is another one; the result holds for all. Pages are sorted by host and path
    over ranges, so a host of any size lies in many tasks. The first and the last page of each range are lent to the ranges beside.
    """
    order = ["host", "anchor", "path", "row"]
    signed = stored(signed, "signatures")
    first = F.min(F.struct("path", "row", "hashes", "zones", "sizes")).alias("first")
    lists = signed.groupBy("host", "anchor", "whole").agg(first)
    ranges = in_ranges(lists.select("host", "anchor", "whole", "first.*"), order, "page-ranges")
    ends = ranges.groupBy("part").agg(F.max("at").alias("last")).orderBy("part").collect()
    lent = [
        row
        for (part, last), following in zip(ends, [*ends[1:], None])
        if following is not None
        for row in ((part, last, following[0]), (following[0], 0, part))
    ]
    steps = ranges.sparkSession.createDataFrame(lent, "part bigint, at bigint, to bigint")
    borrowed = ranges.join(F.broadcast(steps), ["part", "at"]).drop("part").withColumnRenamed("to", "part")
    every = ranges.withColumn("own", F.lit(True)).unionByName(borrowed.withColumn("own", F.lit(False)))
    every = every.drop("at").repartition("part").sortWithinPartitions("part", *order)
    schema = StructType([
        StructField("host", StringType()), StructField("whole", BinaryType()),
        StructField("shared", ArrayType(IntegerType())),
    ])
    found = every.mapInArrow(_compare, schema)
    both = F.array_distinct(F.flatten(F.collect_list("shared")))  # of two placings
    found = found.groupBy("host", "whole").agg(both.alias("shared"))
    members = signed.where("anchor = 0").select("row", "host", "whole").dropDuplicates(["row"])
    return members.join(found, ["host", "whole"]).select("row", "shared")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page beside its two neighbours of the same range."""

    def pages() -> Iterator[dict | None]:
        for batch in batches:
            yield from batch.to_pylist()
        yield None

    before = page = None
    hosts, wholes, shared = [], [], []
    for after in pages():
        if page is not None and page["own"]:
            left = before if before and before["part"] == page["part"] else None
            right = after if after and after["part"] == page["part"] else None
            hosts.append(page["host"])
            wholes.append(page["whole"])
            shared.append(template_lines(left, page, right))
        before, page = page, after
        if len(hosts) == 5000 or after is None:
            arrays = [
                pa.array(hosts, pa.string()), pa.array(wholes, pa.binary()),
                pa.array(shared, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "whole", "shared"])
            hosts, wholes, shared = [], [], []


def main_text(lines: list[Line], shared: list[int] | None) -> tuple[str, int, int]:
    """The text that is left, and how many lines fell to a pair and to their zone.

    After the shared lines, what stands in menus, forms and the like goes, which a
    page without a pair still has; and beside a marked article all that is outside of it
    and of <main>.
    """
    outside = [i for i, line in enumerate(lines) if line.zone != ARTICLE]
    gone = {outside[i] for i in shared or ()}
    left = [line for i, line in enumerate(lines) if i not in gone]
    main = main_zones(lines)
    kept = [line.text for line in left if line.zone in main]
    return "\n".join(kept), len(gone), len(left) - len(kept)


def extracted(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """``(id, url, text, n_shared, n_frame)`` for each page.

    A page is paired with the page of its host whose path is nearest, and with the
    nearest of those that begin with the same line; lines that a longest common
    subsequence of both has are deleted, also those in <main>. Lines of an <article>
    stay, as articles may quote or copy each other. Null or empty html
    gives an empty text; a null URL has no pair. Ids may be null or repeat.
    """
    shared = differences(signatures(pages, html_column, url_column))
    rows = pages.select(
        row_key(F.col(url_column), F.col(html_column)).alias("row"), F.col(id_column).alias("id"),
        F.col(url_column).alias("url"), F.col(html_column).alias("html"),
    )
    packed = StructType([
        StructField("row", BinaryType()), rows.schema["id"], rows.schema["url"],
        StructField("lines", BinaryType()),
    ])

    def pack():
        def work(batch):
            found = [[(x.text, x.zone) for x in lines_of(h)] for h in column(batch, "html")]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("row", "id", "url")}
            yield columns | {"lines": [zlib.compress(json.dumps(p).encode(), 6) for p in found]}

        return work

    lines = map_rows(rows, pack, packed, 500)
    joined = lines.join(shared, "row", "left")
    schema = StructType([
        rows.schema["id"], rows.schema["url"], StructField("text", StringType()),
        StructField("n_shared", IntegerType()), StructField("n_frame", IntegerType()),
    ])

    def finish():
        def work(batch):
            made = [
                main_text([Line(*x) for x in json.loads(zlib.decompress(raw))], gone)
                for raw, gone in zip(column(batch, "lines"), column(batch, "shared"))
            ]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "url")}
            yield columns | {n: [m[i] for m in made] for i, n in enumerate(("text", "n_shared", "n_frame"))}

        return work

    return map_rows(joined, finish, schema, 500)
