"""A table of the store in buckets by key, so that a command writes only the buckets it touches.

Each bucket is a table of the store of its own, named after its number and the
number of all; a manifest names those of one split.  A row lies in the bucket of
the CRC-32 of its key as text, which driver and tasks compute alike.  The number of
buckets follows the number of rows when the whole table is written, so a bucket, and
with it what a small command reads and writes, has about ``ROWS`` rows at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.sources.store import Store, Written, empty

ROWS = 50_000
PART = "bucket__"


class Buckets:
    """Table ``name`` of ``store``, dealt by ``key``."""

    def __init__(self, store: Store, name: str, schema: str, key: str, rows: int | None = None):
        self.store, self.name, self.schema, self.key, self.rows = store, name, schema, key, rows or ROWS

    # ------------------------------------------------------------ where rows lie
    def tables(self, manifest: dict | None = None) -> dict[int, str]:
        """Names of the buckets in a version, by number."""
        names = [t for t in (manifest or self.store.manifest())["tables"] if t.startswith(f"{self.name}.") and "of" in t]
        return {int(t.rsplit(".", 1)[1].split("of")[0]): t for t in names}

    def count(self) -> int:
        names = list(self.tables().values())
        return int(names[0].rsplit("of", 1)[1]) if names else 0

    @staticmethod
    def place(key: Column, n: int) -> Column:
        return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)).cast("int")

    @staticmethod
    def number(key, n: int) -> int:
        """Bucket of a key, on the driver."""
        return zlib.crc32(str(key).encode()) % n

    # ------------------------------------------------------------ reading
    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of some buckets, of all without a choice."""
        manifest = self.store.manifest()
        chosen = None if buckets is None else set(buckets)
        paths = [p for b, t in sorted(self.tables(manifest).items()) if chosen is None or b in chosen for p in manifest["tables"][t]]
        spark = self.store.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else empty(spark, self.schema)

    def of_keys(self, keys: Iterable) -> DataFrame:
        """The buckets that can hold ``keys``; callers still filter by them."""
        n = self.count()
        return self.read({self.number(k, n) for k in keys} if n else ())

    # ------------------------------------------------------------ writing
    def _write(self, rows: DataFrame, n: int) -> dict[int, str]:
        """Store rows by bucket in one job; paths of the buckets that have any."""
        placed = rows.withColumn(PART, self.place(F.col(self.key), n))
        path = self.store.folder(self.name)
        placed.repartition(min(n, 4096), PART).write.partitionBy(PART).parquet(path)
        return {int(name.split("=")[1]): f"{path}/{name}" for name in self.store.listed(path) if name.startswith(f"{PART}=")}

    def _named(self, b: int, n: int) -> str:
        return f"{self.name}.{b:05d}of{n:05d}"

    def whole(self, rows: DataFrame, count: int) -> dict[str, Written]:
        """What a commit needs to replace the table by ``rows`` (``count`` of them), in as many buckets as that asks for."""
        n = 1 << max(0, -(-count // self.rows) - 1).bit_length()
        paths = self._write(rows, n)
        stale = {t: Written(None, None) for t in self.tables().values()}
        return stale | {self._named(b, n): Written(paths.get(b), None, keep=True) for b in range(n)}

    def changed(self, rows: DataFrame, removed: DataFrame | None = None) -> dict[str, Written]:
        """What a commit needs to put ``rows`` in place of those with their keys, and to take ``removed`` keys out: the touched buckets alone."""
        n = self.count()
        if not n:
            return self.whole(rows, rows.count())
        keys = rows.select(self.key)
        keys = keys if removed is None else keys.unionByName(removed.select(self.key))
        touched = {r[0] for r in keys.select(self.place(F.col(self.key), n)).distinct().collect()}
        kept = self.read(touched).join(keys.distinct(), self.key, "left_anti")
        paths = self._write(kept.unionByName(rows.select(*kept.columns)), n)
        return {self._named(b, n): Written(paths.get(b), None, keep=True) for b in touched}

    def added(self, rows: DataFrame) -> dict[str, Written]:
        """What a commit needs to append ``rows``: a folder for each bucket that gets any."""
        n = self.count()
        return {self._named(b, n): Written(path, None) for b, path in self._write(rows, n).items()}

    def folders(self) -> int:
        """The most folders that a bucket has."""
        manifest = self.store.manifest()
        return max((len(manifest["tables"][t]) for t in self.tables(manifest).values()), default=0)
