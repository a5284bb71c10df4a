"""Structured Streaming jobs: idempotent edge upserts, the steward's decisions and changed facts as state, stage counts by event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from fundloom.operators import steward

EDGE = "subject string, rel string, object string, corroboration long, confidence double, doc_ids array<long>"


#: Buckets of an edge table; a batch rewrites those that its edges fall in.
BUCKETS = 64


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("subject", "rel", "object"), F.lit(n)).cast("int")


def commit(root: str, version: int) -> str:
    return f"{root}/commits/v{version:08d}"


def committed(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def places(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """Of each bucket the version that wrote it last: one number a bucket."""
    return {} if version == 0 else {r["bucket"]: r["version"] for r in spark.read.parquet(commit(root, version)).collect()}


def latest(spark: SparkSession, root: str, upto: int, buckets: list[int] | None = None) -> DataFrame:
    """The edge table before batch ``upto`` (counted from 0), or some buckets of it; empty before the first."""
    paths = [f"{root}/data/v{v:08d}/bucket={b}" for b, v in sorted(places(spark, root, upto).items()) if buckets is None or b in buckets]
    return spark.read.schema(EDGE).parquet(*paths) if paths else spark.createDataFrame([], EDGE)


def merge_batch(batch: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> None:
    """Merge the triples of batch ``number`` into the edge table: the buckets that they fall in are read, merged and written anew, then one commit
    says where each bucket lies. A batch that is run again after its commit does nothing; before it, it writes the same files over."""
    spark, version = batch.sparkSession, number + 1
    if committed(spark, commit(root, version)):
        return
    batch = batch.persist()
    touched = [r["b"] for r in batch.select(bucket_of(buckets).alias("b")).distinct().collect()]
    if touched:
        merged = steward.upsert_edges(latest(spark, root, number, touched), batch).withColumn("bucket", bucket_of(buckets))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v{version:08d}")
    batch.unpersist()
    now = places(spark, root, number) | {b: version for b in touched}
    spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(commit(root, version))


def upsert_stream(triples: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS):
    """Each micro-batch of accepted triples (subject, rel, object, ord, confidence, doc_id) becomes a new version of the edge table."""
    return triples.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, root, number, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window of event time, rows later than the watermark left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


DECISIONS = "ord {}, subject string, rel string, object string, decision string, corroboration long"
#: Where keyed map state is kept: the store that processors with named states need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Steward(StatefulProcessor):
    """State of a (subject, rel): how often each object was said, and how many objects there are. A row reads and writes its own object only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", "object string", "n long")
        self.objects = handle.getValueState("objects", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        subject, rel = key
        objects, known, out = self.objects.get()[0] if self.objects.exists() else 0, {}, []
        for r in pd.concat(list(rows)).sort_values("ord", kind="stable").itertuples():
            if r.object not in known:
                known[r.object] = self.said.getValue((r.object,))[0] if self.said.containsKey((r.object,)) else 0
                objects += known[r.object] == 0
            n = known[r.object] = known[r.object] + 1
            conflict = rel in steward.FUNCTIONAL and n == 1 and objects > 1
            out.append((r.ord, subject, rel, r.object, "conflict" if conflict else "corroborate" if n > 1 else "insert", n))
        for object_, n in known.items():
            self.said.updateValue((object_,), (n,))
        self.objects.update((objects,))
        yield pd.DataFrame(out, columns=["ord", "subject", "rel", "object", "decision", "corroboration"])

    def close(self) -> None:
        pass


def steward_state(triples: DataFrame) -> DataFrame:
    """Decisions on a stream of accepted triples (ord, subject, rel, object), the same as of one batch however it is cut.

    Within a micro-batch the triples of a subject and relation go by ``ord`` as its type has it (numbers by size), so it must rise from one
    batch to the next."""
    triples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = triples.select("ord", "subject", "rel", "object")
    return rows.groupBy("subject", "rel").transformWithStateInPandas(Steward(), DECISIONS.format(rows.schema["ord"].dataType.simpleString()), "Append", "None")


CHANGES = "name string, subject string, object string, change string, old_value string, new_value string"


#: Groups of identities whose state is kept together; a batch reads and writes the groups that its facts fall in.
GROUPS = 4096


def impact_stream(facts: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Changes in a stream of facts (name, subject, object, payload, ord): added when an identity is first seen, changed when its payload
    is another one than before. State is the last payload of each identity; a null object is an identity of its own.

    Identities are dealt by hash over ``groups`` states, so a worker is called once for many of them; more groups make smaller states."""

    def compare(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {(n, s, o): p for n, s, o, p in json.loads(state.get[0])} if state.exists else {}
        rows, out = pd.concat(list(batches)).sort_values("ord", kind="stable"), []
        columns = ([None if pd.isna(x) else x for x in rows[c].tolist()] for c in ("name", "subject", "object", "payload"))
        for name, subject, object_, payload in zip(*columns, strict=True):
            k = (name, subject, object_)
            seen, old = k in held, held.get(k)
            if not seen or payload != old:
                out.append((*k, "changed" if seen else "added", old, payload))
            held[k] = payload
        state.update((json.dumps([[*k, p] for k, p in held.items()]),))
        yield pd.DataFrame(out, columns=["name", "subject", "object", "change", "old_value", "new_value"])

    keyed = facts.select("name", "subject", "object", "payload", "ord", F.pmod(F.xxhash64("name", "subject", F.coalesce(F.concat(F.lit("o"), "object"), F.lit(""))), F.lit(groups)).alias("k"))
    return keyed.groupBy("k").applyInPandasWithState(compare, CHANGES, "held string", "append", GroupStateTimeout.NoTimeout)
