"""A table of latest values as a compacted base, a tail of batches and a versioned manifest.

Parquet has no in-place update, so every store operation appends a batch of rows with a version,
and the newest row of a key counts.  Compaction folds the batches into a base that has one row
per key, cut into parts by a hash of the key; only the parts that the batches touch are written
anew.  A manifest names the folder of every part and the batches folded into them.

Nothing that a manifest names is ever changed, and a manifest appears under its number at once, so
a reader sees one version: the base of the newest manifest and the batches not folded into it,
whatever is written meanwhile.  A batch counts once it is complete; one written again under its
name replaces itself, and one folded already is passed over.  One compaction runs at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.sources.latest import latest

_EMPTY: dict[str, Any] = {"version": 0, "parts": {}, "folded": []}


@dataclass(frozen=True)
class ChangeLog:
    """The change log of a table in folder ``path``; ``schema`` has the key and version columns.

    ``parts`` is fixed with the first compaction.  Choose it so that a part's share of the table
    is a few files' worth.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    version: tuple[str, ...]
    parts: int = 64

    # Files --------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        files, where = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []

    def _complete(self, folder: str) -> bool:
        files, where = self._hadoop(f"{self.path}/{folder}/_SUCCESS")
        return files.exists(where)

    def _versions(self) -> list[str]:
        return [n for n in self._names("manifest") if n.endswith(".json")]

    def _manifest(self, name: str) -> dict[str, Any]:
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()[0])

    def manifest(self) -> dict[str, Any]:
        """The newest one: its ``version``, the folder of each part, and the names of the folded batches."""
        names = self._versions()
        return self._manifest(names[-1]) if names else dict(_EMPTY)

    def _publish(self, manifest: dict[str, Any]) -> None:
        name = f"{self.path}/manifest/{manifest['version']:012d}"
        files, draft = self._hadoop(f"{name}.{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf8"))
        out.close()
        final = self._hadoop(f"{name}.json")[1]
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"another compaction has written {name}.json")

    # Rows ---------------------------------------------------------------------------

    def append(self, rows: DataFrame, batch: str) -> None:
        """Stores ``rows`` as the batch of this name; repeating it changes nothing."""
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        typed.write.mode("overwrite").parquet(f"{self.path}/tail/{batch}")

    def _tail(self, manifest: dict[str, Any]) -> list[str]:
        folded = set(manifest["folded"])
        return [b for b in self._names("tail") if b not in folded and self._complete(f"tail/{b}")]

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _rows(self, manifest: dict[str, Any], tail: Sequence[str], parts: Sequence[str]) -> DataFrame:
        base = [f"base/{manifest['parts'][p]}/part={p}" for p in parts if p in manifest["parts"]]
        return self._read([*base, *[f"tail/{b}" for b in tail]])

    def log(self) -> DataFrame:
        """The rows of base and tail, as of now, with their versions."""
        manifest = self.manifest()
        return self._rows(manifest, self._tail(manifest), list(manifest["parts"]))

    def current(self) -> DataFrame:
        """The newest row of every key, without its version."""
        return latest(self.log(), self.keys, self.version)

    def compact(self) -> int:
        """Folds the complete batches into the base; returns the version of the manifest that names it."""
        manifest = self.manifest()
        tail = self._tail(manifest)
        if not tail:
            return manifest["version"]
        count = manifest.get("count", self.parts)
        part = F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int").alias("part")
        touched = self._read([f"tail/{b}" for b in tail]).select(part).distinct().collect()  # ``parts`` at most
        parts = [str(r["part"]) for r in touched]
        rows = self._rows(manifest, tail, parts)
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct(*self.version)).alias("__row")
        kept = rows.groupBy(*self.keys).agg(newest).select(*self.keys, "__row.*").select(*self.schema.names, part)
        folder = uuid.uuid4().hex
        kept.repartition("part").write.partitionBy("part").parquet(f"{self.path}/base/{folder}")
        present = set(self._names("tail"))
        self._publish(
            {
                "version": manifest["version"] + 1,
                "count": count,
                "parts": manifest["parts"] | dict.fromkeys(parts, folder),
                "folded": [b for b in manifest["folded"] if b in present] + tail,
            }
        )
        return manifest["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what none of the newest ``keep`` manifests needs; readers of older ones must have ended."""
        names = self._versions()
        kept = [self._manifest(n) for n in names[-keep:]]
        if not kept:
            return
        used = {f"{folder}/part={p}" for m in kept for p, folder in m["parts"].items()}
        old = [f"base/{f}/{p}" for f in self._names("base") for p in self._names(f"base/{f}") if p.startswith("part=")]
        gone = [o for o in old if o.removeprefix("base/") not in used]
        gone += [f"tail/{b}" for b in kept[0]["folded"]]  # the oldest reader has these in its base
        gone += [f"manifest/{n}" for n in names[:-keep]]
        for folder in gone:
            files, where = self._hadoop(f"{self.path}/{folder}")
            files.delete(where, True)
