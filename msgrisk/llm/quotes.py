"""Operator 8: conversations in reply order, by linking quotations to what they quote."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from msgrisk.llm.common import column, in_ranges, map_rows, row_key, stored

MARKS = re.compile(r"\s{0,3}>(?:\s?>)*")  # the quotation marks that open a line
LEAD_IN = re.compile(r"\s*On\b.*\bwrote:\s*")  # stands before a quotation


def levels(text: str | None) -> list[tuple[int, str]]:
    """The lines of a message with their quote level; 0 is the message's own text."""
    out = []
    for line in (text or "").split("\n"):
        found = MARKS.match(line)
        out.append((found[0].count(">"), line[found.end() :]) if found else (0, line))
    return out


def normalised(line: str) -> str:
    """White space and case do not count when quotations are compared."""
    return " ".join(line.split()).lower()


def passages(text: str | None) -> set[tuple[int, str]]:
    """Normalised passages with their levels: paragraphs, and the lines they consist of.

    Lines of one level that follow each other are one paragraph; an empty line ends it.
    Joined by single spaces, a paragraph is the same however its lines are wrapped; lines
    count too, for replies that quote a paragraph in parts.
    """
    found: set[tuple[int, str]] = set()
    held: list[str] = []
    at = 0
    for level, line in [*levels(text), (0, "")]:
        plain = normalised(line)
        if held and (level != at or not plain):
            found.add((at, " ".join(held)))
            held = []
        at = level
        if plain:
            held.append(plain)
            found.add((level, plain))
    return found


def own_text(text: str | None) -> str | None:
    """A message without its quotations and the line that leads in to one."""
    lines = levels(text)
    if all(level == 0 for level, _ in lines):
        return text
    kept = []
    for (level, line), (following, _) in zip(lines, [*lines[1:], (0, "")]):
        if level == 0 and not (following > 0 and LEAD_IN.fullmatch(line)):
            kept.append(line)
    return "\n".join(kept).strip("\n")


def _passages(messages: DataFrame, quoted: bool) -> DataFrame:
    """Hashes of the passages that messages quote, or of their own."""
    schema = StructType([
        messages.schema["conv"], messages.schema["turn"], StructField("row", BinaryType()),
        StructField("level", IntegerType()), StructField("hash", LongType()),
    ])

    def make():
        def work(batch):
            out = {n: [] for n in schema.names}
            keys = zip(*(column(batch, n) for n in ("conv", "turn", "row")))
            for key, text in zip(keys, column(batch, "text")):
                if quoted and ">" not in (text or ""):
                    continue
                for level, passage in sorted(p for p in passages(text) if (p[0] > 0) == quoted):
                    value = xxhash.xxh64_intdigest(passage) - 2**63
                    for n, v in zip(schema.names, (*key, level, value)):
                        out[n].append(v)
            yield out

        return work

    return map_rows(messages, make, schema)


def _latest(carried: dict[int, tuple], schema: StructType):
    """For each quoted passage the row that last had it as its own, in sorted rows."""

    def make():
        at, held = None, None

        def work(batch):
            nonlocal at, held
            out = {n: [] for n in schema.names}
            names = ("part", "conv", "hash", "own", "row", "level", "turn")
            for part, conv, value, own, row, level, turn in zip(*(column(batch, n) for n in names)):
                if part != at:
                    at, held = part, carried.get(part)
                if own:
                    held = (conv, value, row, turn)
                elif held is not None and held[:2] == (conv, value):
                    for n, v in zip(schema.names, (row, level, *held[2:])):
                        out[n].append(v)
            yield out

        return work

    return make


def linked_passages(messages: DataFrame) -> DataFrame:
    """``(row, level, source, reply_to)`` for each quoted passage that an earlier message has.

    Quoted and own passages are sorted together by conversation, hash and turn over
    ranges, so neither a long conversation nor a line that all repeat meets in one
    task, and no passage is paired with more than the last message that has it.
    """
    quoted = stored(_passages(messages, True), "quoted-passages")
    wanted = quoted.select("conv", "hash").distinct()
    own = _passages(messages, False).join(wanted, ["conv", "hash"], "left_semi")
    both = quoted.withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    order = ["conv", "hash", "turn", "own", "row"]
    ranges = in_ranges(both, order, "quotation-ranges")
    # What each range ends with is one row; it is carried on while the key stays the same.
    last = F.max(F.when(F.col("own"), F.struct("at", "conv", "hash", "row", "turn"))).alias("own")
    edges = ranges.groupBy("part").agg(
        F.min(F.struct("at", "conv", "hash")).alias("first"), last,
        F.max(F.struct("at", "conv", "hash")).alias("last"),
    ).orderBy("part").collect()
    carried, held = {}, None
    for part, first, own_row, _ in edges:
        if held is not None and held[:2] == (first["conv"], first["hash"]):
            carried[part] = held
        if own_row is not None:
            held = tuple(own_row)[1:]
    schema = StructType([
        StructField("row", BinaryType()), StructField("level", IntegerType()),
        StructField("source", BinaryType()), StructField("reply_to", both.schema["turn"].dataType),
    ])
    dealt = ranges.repartition("part").sortWithinPartitions("part", "at")
    return map_rows(dealt, _latest(carried, schema), schema, 10_000)


def threads(parents: DataFrame) -> DataFrame:
    """``(row, root, depth)`` from ``(row, source)``, by doubling of pointers.

    A source comes before its reply, so there are no circles. Each round doubles how
    far a pointer reaches; only rows that have not reached a root go on.
    """
    active = stored(parents.select("row", F.col("source").alias("at"), F.lit(1).alias("steps")), "replies")
    done = None
    while True:
        beyond = active.select(
            F.col("row").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more")
        )
        if done is not None:
            ended = done.select(
                F.col("row").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more")
            )
            beyond = beyond.unionByName(ended)
        moved = stored(active.join(beyond, "at", "left"), "replies")
        ready = moved.where("next is null").select(
            "row", F.col("at").alias("root"), F.col("steps").alias("depth")
        )
        done = ready if done is None else done.unionByName(ready)
        active = moved.where("next is not null").select(
            "row", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps")
        )
        if active.isEmpty():
            return done


def reply_order(
    chats: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(conv, turn, role, text, reply_to, thread, depth)``, one row per message.

    Lines that begin with ``>`` are quotations, more marks are deeper levels. A
    quoted passage, that is a paragraph or a line of one, belongs to the last earlier
    message of the conversation that has the same passage as its own, wherever its lines
    are wrapped. A message replies to the one that has most of its quoted passages,
    counted on the outermost level that has any; the later one wins ties.
    ``reply_to`` and ``thread`` are turns, of that message and of the first in the
    chain of replies; a message that quotes nothing opens a thread of its own with
    depth 0. Sorted by conversation, thread and turn, every reply follows what it
    replies to. ``text`` has no quotations left.

    Messages with a null conversation or turn keep their text cleaned and reply to
    nothing. Null texts stay null. Messages that share a turn do not quote each other.
    An empty table gives an empty result.
    """
    rows = chats.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"), row_key(*map(F.col, (conversation, turn, role, text))).alias("row"),
    )
    placed = rows.where("conv is not null and turn is not null")
    counted = linked_passages(placed.select("conv", "turn", "text", "row"))
    counted = counted.groupBy("row", "level", "source", "reply_to").agg(F.count("*").alias("n"))
    best = counted.groupBy("row").agg(F.max(F.struct(-F.col("level"), "n", "reply_to", "source")).alias("best"))
    chosen = stored(best.select("row", "best.source", "best.reply_to"), "chosen")
    roots = stored(threads(chosen.select("row", "source")), "threads")
    first = placed.select(F.col("row").alias("root"), F.col("turn").alias("thread"))
    first = first.join(roots.select("root").distinct(), "root").distinct()
    replies = chosen.join(roots.join(first, "root"), "row").select("row", "reply_to", "thread", "depth")

    schema = rows.schema

    def make():
        def work(batch):
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in schema.names}
            yield columns | {"text": [own_text(t) for t in column(batch, "text")]}

        return work

    clean = map_rows(rows, make, schema)
    return clean.join(replies, "row", "left").select(
        "conv", "turn", "role", "text", "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
