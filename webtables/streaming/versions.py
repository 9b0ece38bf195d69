"""A table of deltas and a folded base, known by numbered manifests.

A manifest names the base, the deltas since, and the last batch that is in them. A change writes its files first
and then the next manifest, in one atomic step: whoever comes second finds the number taken, looks at the new
state and tries again. Files never change, so a reader keeps the version it began with, and a version is one base plus
the deltas since, each row in exactly one of them.

* ``append`` adds the rows of a batch; a batch that is already in is left out, so a replayed batch counts once, wherever
  the first attempt was stopped.
* ``fold`` writes a new base from a version and puts it in the place of that version's base and deltas; deltas
  that came meanwhile stay.
* ``vacuum`` removes what no kept version names and no writer can still bring in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from webtables.plans import files


@dataclass(frozen=True)
class Version:
    number: int = 0
    base: str | None = None
    deltas: tuple[str, ...] = ()
    last_batch: int = -1

    @property
    def folders(self) -> list[str]:
        return [*([self.base] if self.base else []), *self.deltas]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def numbers(self) -> list[int]:
        return [int(n) for n in files.names(self.spark, f"{self.path}/manifests")]

    def version(self, number: int | None = None) -> Version:
        """A version by its number, the newest by default; version 0 is empty."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Version()
        known = json.loads(files.read_small(self.spark, self._manifest(number)))
        return Version(**{**known, "deltas": tuple(known["deltas"])})

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version: of its base and of its deltas."""
        folders = (version or self.version()).folders
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; ``False`` where it is in already."""
        if batch <= self.version().last_batch:
            return False
        delta = f"deltas/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{delta}")
        return self._change(lambda now: None if batch <= now.last_batch else replace(now, deltas=(*now.deltas, delta), last_batch=batch))

    def fold(self, merge: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace a version's base and deltas by ``merge`` of them; ``False`` where nothing is to be done or another fold was faster."""
        start = self.version()
        if not start.deltas:
            return False
        base = f"bases/{start.number}-{uuid.uuid4().hex}"
        merge(self.read(start)).write.parquet(f"{self.path}/{base}")

        def put(now: Version) -> Version | None:
            if now.base != start.base:
                return None
            return replace(now, base=base, deltas=tuple(d for d in now.deltas if d not in start.deltas))

        return self._change(put)

    def vacuum(self, keep: int = 2) -> None:
        """Keep the newest versions; folders of older ones go, and what stopped attempts have left."""
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        if not kept:
            return
        named = {f for v in kept for f in v.folders}
        newest = kept[-1]
        folded = int(newest.base.partition("/")[2].partition("-")[0]) if newest.base else 0
        for kind, dead in (("deltas", lambda n: n <= newest.last_batch), ("bases", lambda n: n < folded)):
            for name in files.names(self.spark, f"{self.path}/{kind}"):
                if f"{kind}/{name}" not in named and dead(int(name.partition("-")[0])):
                    files.remove(self.spark, f"{self.path}/{kind}/{name}")
        for n in numbers[:-keep]:
            files.remove(self.spark, self._manifest(n))

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}"

    def _change(self, make: Callable[[Version], Version | None]) -> bool:
        while True:
            now = self.version()
            new = make(now)
            if new is None:
                return False
            new = replace(new, number=now.number + 1)
            if files.create_once(self.spark, self._manifest(new.number), json.dumps(asdict(new))):
                return True
