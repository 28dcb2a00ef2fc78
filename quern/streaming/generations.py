"""A queue of content generations that takes each content of a key once, whatever is sent again.

The index of a key is map state: each content digest with its version. A record whose digest the key
has had before is a duplicate, also after others came between. What is new goes to a folder, one
generation for each batch, sealed by a manifest that names the digest of its rows and of the manifest before
it. A batch that is run again, after a failure or by hand, leaves what is sealed as it is; a generation
without its manifest does not count and is written anew.

Defined cases: null keys are a key like others; null digests are a content like others; rows of one
batch are taken in the order (``at``, digest); an empty batch is a generation without rows; state without
``expiry`` is never dropped, with it a digest not seen for that long counts as new, under a new version.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quern.sources.sinks import table_digest

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Generations(StatefulProcessor):
    """Gives (key, digest, at, version) of each content that a key has not had."""

    def __init__(self, names: list[str], expiry_ms: int | None):
        self.names, self.expiry_ms = names, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "digest string", "version int", self.expiry_ms)
        self.last = handle.getValueState("last", "version int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        _, digest, at = self.names
        batch = pd.concat(list(rows)).sort_values([at, digest], kind="stable", na_position="first")
        last = self.last.get()[0] if self.last.exists() else 0
        taken = []
        for content, time in zip(batch[digest], batch[at]):
            name = (json.dumps(None if content is None else str(content)),)  # so that null and the text "null" differ
            if self.seen.containsKey(name):
                if self.expiry_ms:
                    self.seen.updateValue(name, self.seen.getValue(name))  # it has been seen again
                continue
            last += 1
            self.seen.updateValue(name, (last,))
            taken.append((key[0], content, time, last))
        if taken:
            self.last.update((last,))
            yield pd.DataFrame(taken, columns=[*self.names, "version"])

    def close(self) -> None:
        pass


def queued(stream: DataFrame, key: str, digest: str, at: str, expiry_ms: int | None = None) -> DataFrame:
    """The generations of a stream: (key, digest, at, version). The session needs RocksDB's state store."""
    names = [key, digest, at]
    kinds = dict(stream.select(*names).dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", version int"
    return stream.select(*names).groupBy(key).transformWithStateInPandas(Generations(names, expiry_ms), schema, "Append", "ProcessingTime" if expiry_ms else "None")


class Sealed:
    """A folder of sealed generations: ``data/<n>`` with rows, ``manifests/<n>.json`` once they are whole."""

    def __init__(self, spark: SparkSession, folder: str, fault: Callable[[str], None] | None = None):
        self.spark, self.folder, self.fault = spark, folder, fault or (lambda step: None)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, generation: int) -> str | None:
        path, fs = self._path(f"manifests/{generation}.json")
        return self.spark.read.text(path.toString(), wholetext=True).first()[0] if fs.exists(path) else None

    def write(self, rows: DataFrame, generation: int) -> None:
        """Seal ``rows`` as a generation, for ``foreachBatch``. A sealed one stays; other rows under its number are refused."""
        data, _ = self._path(f"data/{generation}")
        sealed = self._manifest(generation)
        if sealed is None:
            rows.write.mode("overwrite").parquet(data.toString())
            self.fault("rows_written")
        # the rows as they were written, so that what is sealed is what readers get; a replay is held against them
        found = table_digest(self.spark.read.parquet(data.toString()) if sealed is None else rows).first()
        before = self._manifest(generation - 1) if generation else ""
        if before is None:
            raise ValueError(f"generation {generation - 1} is not sealed")
        text = json.dumps({"generation": generation, "records": found.records, "sha256": found.sha256, "previous": hashlib.sha256(before.encode()).hexdigest()}, sort_keys=True)
        if sealed is not None:
            if sealed != text:
                raise ValueError(f"generation {generation} is sealed with other rows")
            return
        self.fault("before_manifest")
        part, fs = self._path(f"manifests/.{generation}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(part, self._path(f"manifests/{generation}.json")[0]):
            raise ValueError(f"the manifest of generation {generation} cannot be put in place")

    def manifests(self) -> DataFrame:
        """(generation, records, sha256, previous, linked): ``linked`` if the manifest before has the digest that is named."""
        raw = self.spark.read.text(f"{self.folder}/manifests/*.json", wholetext=True)
        fields = F.from_json("value", "generation long, records long, sha256 string, previous string")
        rows = raw.select(fields.alias("m"), F.sha2("value", 256).alias("_own")).select("m.*", "_own")
        before = rows.select((F.col("generation") + 1).alias("generation"), F.col("_own").alias("_before"))
        start = F.when(F.col("generation") == 0, hashlib.sha256(b"").hexdigest())
        return rows.drop("_own").join(before, "generation", "left").withColumn("linked", F.coalesce(F.col("previous") == F.coalesce("_before", start), F.lit(False))).drop("_before")

    def read(self) -> DataFrame:
        """The rows of all sealed generations, with ``generation``; refused if the chain of manifests is broken."""
        rows = self.manifests().select("generation", "linked").collect()  # a row for each batch
        if sorted(r.generation for r in rows) != list(range(len(rows))) or not all(r.linked for r in rows):
            raise ValueError("the chain of manifests is broken")
        parts = [self.spark.read.parquet(f"{self.folder}/data/{r.generation}").withColumn("generation", F.lit(r.generation)) for r in rows]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def run_queue(stream_of: Callable[[SparkSession], DataFrame], spark: SparkSession, folder: str, key: str, digest: str, at: str, expiry_ms: int | None = None, fault: Callable[[str], None] | None = None) -> Sealed:
    """Take all that ``stream_of`` has now into the sealed folder, from where the last run stopped.

    The stream runs in a session of its own, for the state store is a setting of a session.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    sealed = Sealed(own, folder, fault)
    rows = queued(stream_of(own), key, digest, at, expiry_ms)
    query = rows.writeStream.foreachBatch(sealed.write).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return Sealed(spark, folder, fault)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The newest version of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).where("_n = 1").drop("_n")
