"""State per key between micro-batches, written as it changes.

Keys are dealt to buckets by a hash. A batch reads the buckets of its own keys and
writes one run: the new state of the keys it touched, and nothing else. So what a
batch reads and writes follows its keys and not all keys that were ever seen.

Where a bucket has gathered ``WIDTH`` runs of one level, they become one run of the
next level, in which a key has its newest state only. A row is therefore written once
per level, and a bucket has fewer than ``WIDTH`` runs of each level. Which runs are
valid stands in a manifest per batch, written last: a batch that is run again starts
from the manifest before it and writes the same folders anew. Runs that neither of
the last two manifests names are deleted.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from msgrisk import files

BUCKETS = 64
WIDTH = 8  # runs of one level that become one of the next


@dataclass(frozen=True)
class Manifest:
    """Valid runs ``(level, step)`` of each bucket, and the newest time seen in microseconds."""

    step: int
    buckets: int
    runs: dict[int, list[tuple[int, int]]]
    latest: int | None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def named(self) -> set[tuple[tuple[int, int], int]]:
        return {(run, bucket) for bucket, some in self.runs.items() for run in some}

    @classmethod
    def of_json(cls, text: str) -> Manifest:
        found = json.loads(text)
        runs = {int(b): [tuple(r) for r in some] for b, some in found["runs"].items()}
        return cls(found["step"], found["buckets"], runs, found["latest"])


class KeyedState:
    """One row of state per key below ``path``.

    ``keys`` are columns without nulls, ``values`` the other columns. A key whose column
    ``seen`` lies more than ``idle`` before the newest one of all batches so far has no
    state any more, and its rows go when their bucket is merged; without such a column
    keys stay. The number of buckets is that of the first batch.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: StructType, values: StructType,
        seen: str | None, idle: timedelta, buckets: int = BUCKETS, width: int = WIDTH,
    ):
        if width < 2 or buckets < 1:
            raise ValueError("a state needs a bucket, and runs merge by two at least")
        self.spark, self.path, self.width, self.buckets = spark, path, width, buckets
        self.keys, self.seen, self.idle = keys.names, seen, idle
        self.schema = StructType([*keys.fields, *values.fields])
        self.stored = StructType([*self.schema.fields, StructField("_step", LongType())])

    def steps(self) -> list[int]:
        found = files.names(self.spark, f"{self.path}/manifest")
        return sorted(int(n.split(".")[0]) for n in found if n.endswith(".json"))

    def manifest(self, step: int) -> Manifest:
        """The newest manifest before a batch, or an empty one."""
        earlier = [n for n in self.steps() if n < step]
        if not earlier:
            return Manifest(-1, self.buckets, {}, None)
        return Manifest.of_json(files.read_text(self.spark, self._manifest_path(earlier[-1])))

    def _manifest_path(self, step: int) -> str:
        return f"{self.path}/manifest/{step}.json"

    def _folder(self, run: tuple[int, int], bucket: int) -> str:
        return f"{self.path}/runs/step={run[1]}/level={run[0]}/state_bucket={bucket}"

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _rows(self, manifest: Manifest, buckets: list[int], wanted=lambda run: True) -> DataFrame:
        """The newest row of each key in some buckets, idle ones left out."""
        paths = [self._folder(r, b) for b in buckets for r in manifest.runs.get(b, []) if wanted(r)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).parquet(*paths)
        values = F.struct(*[n for n in self.schema.names if n not in self.keys])
        newest = rows.groupBy(*self.keys).agg(F.max_by(values, "_step").alias("_values"))
        newest = newest.select(*self.keys, "_values.*").select(*self.schema.names)
        return newest.filter(self._alive(manifest.latest))

    def _alive(self, latest: int | None) -> Column:
        if latest is None:
            return F.lit(True)
        return F.unix_micros(self.seen) >= latest - self.idle // timedelta(microseconds=1)

    def before(self, step: int, batch: DataFrame) -> DataFrame:
        """The state of a batch's keys as it was before that batch.

        The driver learns which buckets the batch touches, no more than there are. Only
        these are read, and of them the rows of the batch's keys.
        """
        manifest = self.manifest(step)
        if not manifest.runs:
            return self.spark.createDataFrame([], self.schema)
        keys = batch.select(*self.keys).distinct()
        touched = [r[0] for r in keys.select(self.bucket(manifest.buckets)).distinct().collect()]
        return self._rows(manifest, sorted(touched)).join(keys, self.keys, "left_semi")

    def every(self, step: int | None = None) -> DataFrame:
        """The state of all keys, after the last batch or as it was before one."""
        last = self.steps()[-1:] or [-1]
        manifest = self.manifest(last[0] + 1 if step is None else step)
        return self._rows(manifest, sorted(manifest.runs))

    def commit(self, step: int, touched: DataFrame) -> None:
        """Make the rows of ``touched`` (one per key) the state of their keys."""
        old = self.manifest(step)
        folder = f"{self.path}/runs/step={step}"
        files.remove(self.spark, folder)
        self._write(touched, old.buckets, step, 0)
        runs = {b: list(some) for b, some in old.runs.items()}
        latest = old.latest
        written = self._written(step, 0)
        if written and self.seen:
            rows = self.spark.read.schema(self.stored).parquet(*[self._folder((0, step), b) for b in written])
            newest = rows.agg(F.unix_micros(F.max(self.seen))).first()[0]
            latest = max((t for t in (latest, newest) if t is not None), default=None)
        for b in written:
            runs.setdefault(b, []).append((0, step))
        made = Manifest(step, old.buckets, runs, latest)
        self._merge(made, written)
        kept = {b: some for b, some in made.runs.items() if some}
        text = Manifest(step, old.buckets, kept, latest).to_json()
        files.write_text(self.spark, self._manifest_path(step), text)
        self._clean(old, step)

    def _write(self, rows: DataFrame, buckets: int, step: int, level: int) -> None:
        """A run: one file per bucket, as a bucket's keys go to one task."""
        made = rows.select(*self.schema.names, F.lit(step).cast("long").alias("_step"))
        dealt = made.withColumn("state_bucket", self.bucket(buckets)).repartition("state_bucket")
        dealt.write.partitionBy("state_bucket").parquet(f"{self.path}/runs/step={step}/level={level}")

    def _written(self, step: int, level: int) -> list[int]:
        found = files.names(self.spark, f"{self.path}/runs/step={step}/level={level}")
        return [int(n.split("=")[1]) for n in found if n.startswith("state_bucket=")]

    def _merge(self, manifest: Manifest, touched: list[int]) -> None:
        """Merge full levels of the touched buckets, from the lowest level on."""
        level = 0
        while True:
            full = [b for b in touched if sum(r[0] == level for r in manifest.runs[b]) >= self.width]
            if not full:
                return
            rows = self._rows(manifest, full, lambda run, level=level: run[0] == level)
            self._write(rows, manifest.buckets, manifest.step, level + 1)
            made = set(self._written(manifest.step, level + 1))  # none where all keys are idle
            for b in full:
                kept = [r for r in manifest.runs[b] if r[0] != level]
                manifest.runs[b] = kept + [(level + 1, manifest.step)] * (b in made)
            level += 1

    def _clean(self, old: Manifest, step: int) -> None:
        """Delete the manifests and runs that a batch run again would not need."""
        new = self.manifest(step + 1)
        kept = old.named() | new.named()
        for n in [n for n in self.steps() if n < old.step]:
            for run, bucket in self.manifest(n + 1).named() - kept:
                files.remove(self.spark, self._folder(run, bucket))
            files.remove(self.spark, self._manifest_path(n))
        live = {run[1] for run, _ in kept}
        for folder in files.names(self.spark, f"{self.path}/runs"):
            n = int(folder.split("=")[1])
            if n <= step and n not in live:
                files.remove(self.spark, f"{self.path}/runs/{folder}")
