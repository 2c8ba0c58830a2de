"""Deltas kept up to date by Structured Streaming.

A mapping's result depends on whole snapshots, so each micro-batch folds its
rows into the stored snapshots and computes the deltas once, from one
consistent state, inside ``foreachBatch``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldweave.plans.model import Document
from goldweave.plans.pipeline import Pipeline

#: Name of the source a streamed row belongs to, and of its order of arrival.
SOURCE, ORDER = "_source", "_order"


class Snapshots:
    """The latest row of every key of every source, and the state that sinks hand back, as Parquet folders with a manifest per batch.

    Rows are dealt to ``buckets`` by a hash of their key, and a batch writes
    only the buckets that it touches, into folders of its own.  Its manifest,
    which names the folder of every bucket, is written last.  A batch starts
    from the newest manifest before its own, whatever process wrote that, so a
    restart loses nothing and a batch that is run again ends in the same state.
    """

    def __init__(self, spark: SparkSession, doc: Document, folder: str, buckets: int = 64):
        self.spark, self.doc, self.folder, self.buckets = spark, doc, folder.rstrip("/"), buckets

    def _manifests(self) -> dict[int, str]:
        """Places of the committed manifests by batch."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_manifests")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        found = [s.getPath() for s in fs.listStatus(root)]
        return {int(x.getName().split("=")[1]): x.toString() for x in found if x.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))}

    def before(self, batch: int | None = None) -> dict[str, dict[str, str]]:
        """Folders by source (or name of a state) and bucket, as the last batch before ``batch`` (or the last of all) left them."""
        held = {n: place for n, place in self._manifests().items() if batch is None or n < batch}
        return json.loads(self.spark.read.text(held[max(held)], wholetext=True).first()[0]) if held else {}

    def commit(self, batch: int, versions: dict[str, dict[str, str]]) -> None:
        """The batch is done: everything that its manifest names is there."""
        self.spark.createDataFrame([(json.dumps(versions, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_manifests/batch={batch}")

    def read(self, held: dict[str, str]) -> DataFrame | None:
        """The rows in these folders; None where there are none."""
        places = sorted(set(held.values()))
        return self.spark.read.option("mergeSchema", "true").parquet(*places) if places else None

    def fold(self, source: str, rows: DataFrame, held: dict[str, str]) -> dict[str, str]:
        """The folders of a source after ``rows`` are upserted; rows whose ``_deleted`` is true vanish."""
        key = list(self.doc.sources[source].primary_key)
        fresh = rows.drop(SOURCE)
        columns = [c for c in fresh.columns if c not in (ORDER, "_deleted", *key)]
        gone = F.coalesce(F.col("_deleted").cast("boolean"), F.lit(False)) if "_deleted" in fresh.columns else F.lit(False)
        fresh = fresh.withColumn("_gone", gone).withColumn("_at", F.col(ORDER) if ORDER in fresh.columns else F.lit(0))
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(self.buckets)).cast("int")
        latest = fresh.groupBy(*key).agg(F.max_by(F.struct("_gone", *columns), F.col("_at")).alias("r")).select(*key, "r.*", bucket.alias("_bucket")).persist()
        try:
            touched = {str(r["_bucket"]) for r in latest.select("_bucket").distinct().collect()}  # `buckets` at most
            out = latest.where(~F.col("_gone")).drop("_gone")
            before = self.read({b: place for b, place in held.items() if b in touched})
            if before is not None:
                kept = before.join(latest.select(*key), key, "left_anti").withColumn("_bucket", bucket)
                out = out.unionByName(kept, allowMissingColumns=True)
            return self._put(source, out, {b: place for b, place in held.items() if b not in touched})
        finally:
            latest.unpersist()

    def keep(self, name: str, state: DataFrame) -> dict[str, str]:
        """The folders of a state table that replaces the one before."""
        return self._put(name, state.withColumn("_bucket", F.lit(0)), {})

    def _put(self, name: str, rows: DataFrame, others: dict[str, str]) -> dict[str, str]:
        place = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(place)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        names = [s.getPath().getName() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        return others | {n.split("=")[1]: f"{place}/{n}" for n in names if n.startswith("_bucket=")}

    def prune(self, keep: int = 2) -> None:
        """Delete the manifests but the newest ``keep``, and folders that none of those names."""
        held = self._manifests()
        newest = sorted(held)[-keep:]
        wanted = {place.rsplit("/", 1)[0] for n in newest for v in json.loads(self.spark.read.text(held[n], wholetext=True).first()[0]).values() for place in v.values()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in sorted(held)[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(held[n]), True)
        names = {w.rsplit("/", 1)[1] for w in wanted}
        for part in fs.listStatus(root):
            if part.getPath().getName() != "_manifests":
                for version in fs.listStatus(part.getPath()):
                    if version.getPath().getName() not in names:
                        fs.delete(version.getPath(), True)


def refresh(stream: DataFrame, doc: Document, snapshots: Snapshots, sink: Callable[[Pipeline, int], dict[str, DataFrame] | None], checkpoint: str, **options) -> StreamingQuery:
    """Start a query that updates the snapshots from ``stream`` and hands each batch's pipeline to ``sink``.

    ``stream`` has a ``_source`` column besides the columns of all sources.
    What ``sink`` returns, frames named ``_written_<mapping>`` or
    ``_cluster_members_<mapping>`` (see ``feed_back``), is the state of the next
    batch's pipeline.  A batch is committed after its sink has returned; one
    that failed before is run again, so a sink must bear to see it twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        versions = snapshots.before(number)
        rows = rows.persist()
        try:
            for name in doc.sources:
                own = rows.where(F.col(SOURCE) == name)
                if not own.isEmpty():
                    versions[name] = snapshots.fold(name, own, versions.get(name, {}))
        finally:
            rows.unpersist()
        held = {name: df for name, v in versions.items() if (df := snapshots.read(v)) is not None}
        sources = {n: df for n, df in held.items() if n in doc.sources}
        if sources:
            state = sink(Pipeline(doc, sources, {n: df for n, df in held.items() if n not in doc.sources}), number)
            versions |= {name: snapshots.keep(name, df) for name, df in (state or {}).items()}
        snapshots.commit(number, versions)
        snapshots.prune()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.trigger(**v) if k == "trigger" else writer.option(k, v)
    return writer.start()


def feed_back(pipe: Pipeline, mapping: str, columns: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """What a writer should record after it has applied a mapping's deltas: (cluster members, written state)."""
    frame = pipe.frame(mapping)
    members = pipe.members(pipe.doc.mappings[mapping]).select(F.col("__id").alias("_cluster_id"), F.col("__pk").alias("_src_id"))
    kept = F.map_filter("out", lambda k, _: k.isin(columns)) if columns else F.col("out")
    written = frame.where(F.col("_action").isin("insert", "update", "noop")).groupBy(F.col("__id").alias("_cluster_id")).agg(F.first(F.to_json(kept)).alias("_written"))
    return members, written.withColumn("_written_at", F.lit(at))
