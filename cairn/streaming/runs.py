"""The same operators over data that keeps arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ledger import LEDGER
from cairn.session import join_counted, materialize
from cairn.sources import store
from cairn.sources.store import KeptStore


#: What makes a run invalid, in the order in which it is told.
NO_HEADER, AFTER_END, UNDONE_TWICE = "no header", "event after end", "undone twice"


def run_status(events: DataFrame) -> DataFrame:
    """Live state of each run, from a stream (or table) of ledger events: ``(run_id, transferred, bytes, state, problem, last_seq)``.

    ``invalid``: its least event isn't a header, a file or folder event follows its end, or it was undone twice (``problem`` tells which); else ``undone``, ``finished``
    after its end, or ``open``. All of it follows from counts and from the least and greatest ``seq`` of each kind, so events may come in any order and in any
    batches: a late one corrects what was told before. A run costs one row of state.
    """
    is_ = lambda *kinds: F.col("type").isin(*kinds)
    at = lambda how, *kinds: how(F.when(is_(*kinds), F.col("seq")))
    out = events.groupBy("run_id").agg(
        F.min_by("type", "seq").alias("first"), F.count_if(is_("file")).alias("transferred"), F.coalesce(F.sum(F.when(is_("file"), F.col("size"))), F.lit(0)).alias("bytes"),
        at(F.min, "end").alias("end"), at(F.max, "file", "mkdir", "rmdir").alias("work"), F.count_if(is_("undo")).alias("undos"), F.max("seq").alias("last_seq"),
    )
    problem = F.when(F.col("first") != "run", NO_HEADER).when(F.col("work") > F.col("end"), AFTER_END).when(F.col("undos") > 1, UNDONE_TWICE)
    state = F.when(problem.isNotNull(), "invalid").when(F.col("undos") > 0, "undone").when(F.col("end").isNotNull(), "finished").otherwise("open")
    return out.select("run_id", "transferred", "bytes", state.alias("state"), problem.alias("problem"), "last_seq")


def watch_ledger(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_trigger).json(path)


def keep_status(events: DataFrame, path: str, stream: str = "ledger") -> KeptStore:
    """Takes what has arrived into the store of run states below ``path``: of each batch only runs whose state it changed are written.

    Later calls go on where the last one ended; a batch that is tried again counts once.
    """
    kept = KeptStore(events.sparkSession, path, "run_id")
    changed = run_status(events)

    def take_in(batch: DataFrame, n: int) -> None:
        kept.commit(batch, stream, n)

    changed.writeStream.outputMode("update").option("checkpointLocation", f"{kept.path}/progress/{stream}").trigger(availableNow=True).foreachBatch(take_in).start().awaitTermination()
    return kept


def mark_copies(arrivals: DataFrame, path: str, keep: str | None = "interval 30 days", stream: str = "arrivals", compact_every: int = 16) -> None:
    """Tells of files (path, digest, seen) as they arrive which are copies; ``marked`` reads ``(path, digest, seen, copy_of)`` from below ``path``.

    The first file of a digest has no ``copy_of``, all later ones name it; within a batch the first is that with the least (seen, path). A batch is reduced to a row a digest
    before it meets what is known, so a digest that a third of a batch has costs a row a task; known digests are a store of which only the batch's own
    are looked up. A digest that wasn't seen for ``keep`` before the newest file is forgotten, when the store is compacted and in what is told, which bounds
    the store by the digests of that time; with None nothing is forgotten. Files without digest are no copies. A batch that is tried again counts once.
    """
    spark = arrivals.sparkSession
    kept = KeptStore(spark, f"{path}/digests", "digest")

    def take_in(batch: DataFrame, n: int) -> None:
        if kept.has(stream, n):
            return
        batch = materialize(batch.select("path", "digest", "seen"), "arrivals")
        new = batch.where("digest is not null").groupBy("digest").agg(F.min(F.struct("seen", "path")).alias("f"), F.max("seen").alias("last"), F.count(F.lit(1)).alias("n"))
        new = materialize(new.select("digest", F.col("f.path").alias("first"), "last", "n"), "digests")
        known = kept.read(only=new)
        if known is None:
            known = new.limit(0)
        # by the clock of the files themselves: what the newest of a digest's batch comes too late for is forgotten
        old = known.select("digest", F.col("first").alias("old"), F.col("last").alias("old_last"))
        recent = F.col("old").isNotNull() if keep is None else F.col("old_last") >= F.col("last") - F.expr(keep)
        met = new.join(old, "digest", "left").withColumn("known", F.coalesce(recent, F.lit(False)))
        owners = materialize(met.select("digest", F.when(F.col("known"), F.col("old")).otherwise(F.col("first")).alias("owner"), "known", F.greatest("last", F.coalesce("old_last", "last")).alias("last"), "n"), "owners")
        named = join_counted(batch, owners.drop("last"), "digest", "n", batch.count())
        copy = F.when(F.col("owner") != F.col("path"), F.col("owner"))
        named.select("path", "digest", "seen", copy.alias("copy_of")).write.mode("overwrite").parquet(f"{path}/marked/batch={n}")
        made = kept.commit(owners.select("digest", F.col("owner").alias("first"), "last"), stream, n)
        if made and made.number % compact_every == 0:
            newest = kept.read().agg(F.max("last")).first()[0]
            kept.compact(None if keep is None else F.col("last") >= F.lit(newest) - F.expr(keep))

    arrivals.writeStream.option("checkpointLocation", f"{path}/progress/{stream}").trigger(availableNow=True).foreachBatch(take_in).start().awaitTermination()


def marked(spark: SparkSession, path: str) -> DataFrame:
    """What ``mark_copies`` has told so far."""
    return spark.read.parquet(f"{path}/marked").drop("batch")


def refresh_store(listing: DataFrame, path: str, version: int, compute: Callable[[DataFrame], DataFrame], stream: str = "listings") -> None:
    """Takes all new listings of a stream (path, size, mtime, ...) into the store below ``path``; ``KeptStore.read`` reads it.

    ``compute`` turns files into feature rows, one a path; what the store knows already isn't computed again, and a path that changed has its
    new row in place of the old one. Of a path that a batch lists twice the later ``mtime`` counts. The stream's progress lies
    in the store, by the name ``stream``: a later call goes on where the last one ended, and a batch that is tried again after it was
    committed changes nothing. Streams of different names share a store; each commit has the next number of all.
    """
    kept = KeptStore(listing.sparkSession, path)

    def take_in(batch: DataFrame, n: int) -> None:
        if kept.has(stream, n):
            return
        once = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), F.struct("mtime", "size")).alias("r")).select("path", "r.*")
        have = kept.read()
        todo = once if have is None else store.to_do(once, have, version)
        kept.commit(compute(todo).withColumn("version", F.lit(version)), stream, n)

    listing.writeStream.option("checkpointLocation", f"{kept.path}/progress/{stream}").trigger(availableNow=True).foreachBatch(take_in).start().awaitTermination()
