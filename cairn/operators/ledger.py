"""The ledger of runs: events, summaries, and what undoing a run would do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.session import materialize, small_side
from cairn.sources import journals

EVENT = "type string, id string, operation string, source string, dest string, started timestamp, path string, src string, dst string, size long, finished timestamp, transferred long, skipped long, failed long, bytes long, cancelled boolean, at timestamp, restored long, problems long"
LEDGER = f"run_id string, seq long, {EVENT}"


def append(events: DataFrame, path: str) -> None:
    """Adds events (``run_id``, ``seq`` and those of ``EVENT``) to a ledger: as many files as there are tasks, however many runs."""
    events.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """Foreign journals, a JSON-lines file to a run: blank lines are passed over, all from the first broken line on is left out.

    ``run_id`` is the file, ``seq`` the line. Long files are cut at line ends; a line's number is its place in its own piece and
    the number of lines in the pieces before, so a file of any length is read by many tasks.
    """
    lines = journals.lines(spark, path)
    event = F.from_json("value", EVENT + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.withColumn("e", F.when(F.trim("value") != "", event)).withColumn("broken", (F.trim("value") != "") & (F.col("e").isNull() | F.col("e._corrupt_record").isNotNull()))
    parsed = materialize(parsed.drop("value"), "journal-lines")
    # a piece's lines follow each other in one task, so their numbers there differ as their places do
    pieces = parsed.groupBy("run_id", "piece").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("broken"), F.col("at"))).alias("bad"))
    before = F.sum("n").over(Window.partitionBy("run_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))  # a row a piece
    placed = pieces.withColumn("offset", F.coalesce(before, F.lit(0)) - F.col("start"))
    end = F.min(F.col("bad") + F.col("offset")).over(Window.partitionBy("run_id"))
    placed = materialize(placed.withColumn("end", end).select("run_id", "piece", "offset", "end"), "journal-pieces")
    seq = F.col("at") + F.col("offset")
    good = parsed.where("e is not null").join(small_side(placed, 256), ["run_id", "piece"]).where(F.col("end").isNull() | (seq < F.col("end")))
    return good.select("run_id", seq.alias("seq"), "e.*").drop("_corrupt_record")


def run_summaries(journal: DataFrame) -> DataFrame:
    """A row per run whose first event is its header.

    Files and bytes transferred come from file events; the rest from the last trailer; a run without
    trailer was interrupted; undone_at is the last undo's.
    """
    is_ = lambda kind: F.col("type") == kind
    last = lambda column, kind: F.max_by(column, F.when(is_(kind), F.col("seq")))
    runs = journal.groupBy("run_id").agg(
        F.min_by("type", "seq").alias("first"), F.min_by("operation", "seq").alias("operation"), F.min_by("started", "seq").alias("started"),
        F.count_if(is_("file")).alias("transferred"), F.coalesce(F.sum(F.when(is_("file"), F.col("size"))), F.lit(0)).alias("bytes"),
        last("skipped", "end").alias("skipped"), last("failed", "end").alias("failed"), last("cancelled", "end").alias("cancelled"), last("finished", "end").alias("finished"),
        last("at", "undo").alias("undone_at"), (F.count_if(is_("end")) == 0).alias("interrupted"),
    )
    return runs.where("first = 'run'").drop("first")


def history(journal: DataFrame, limit: int = 200) -> DataFrame:
    """The newest runs first: the page of a history that is shown."""
    return run_summaries(journal).orderBy(F.desc("started"), "run_id").limit(limit)


def undo_outcomes(journal: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(run_id, seq, src, dst, outcome)`` for each transferred file, last first in ``undo_order``.

    ``inventory`` has (path, size) as things are now. Runs that were undone, or whose first event isn't
    a header, are left out; so is an interrupted run's missing tail.
    """
    runs = run_summaries(journal).where("undone_at is null").select("run_id", "operation")
    files = journal.where("type = 'file'").select("run_id", "seq", "src", "dst", "size").join(runs, "run_id")
    now = inventory.select("path", F.col("size").alias("_size"))
    at_src = now.select(F.col("path").alias("src"), F.lit(True).alias("has_src"))
    at_dst = now.select(F.col("path").alias("dst"), F.col("_size").alias("dst_size"))
    met = files.join(at_src, "src", "left").join(at_dst, "dst", "left")
    src, dst = F.col("has_src").isNotNull(), F.col("dst_size").isNotNull()
    moved = F.when(dst & ~src, "restored").when(src & ~dst, "already_back").when(src & dst, "problem_original_spot").otherwise("problem_missing")
    copied = F.when(~dst, "already_gone").when(F.col("dst_size") != F.col("size"), "problem_changed").otherwise("restored")
    outcome = F.when(F.col("operation") == "move", moved).otherwise(copied)
    return met.select("run_id", "seq", "src", "dst", outcome.alias("outcome"))


def undo_order(outcomes: DataFrame) -> DataFrame:
    return outcomes.orderBy("run_id", F.desc("seq"))


def emptied_folders(before: DataFrame, moved: DataFrame, root: str) -> DataFrame:
    """Folders below ``root`` of which nothing is left when the ``moved`` paths are gone, deepest first in ``depth``.

    Files named ``.DS_Store`` don't keep a folder; only folders that something moved out of count.
    """
    state = before.select("path").join(moved.select("path").distinct().withColumn("gone", F.lit(1)), "path", "left")
    parts = F.split(F.substring(paths.parent(F.col("path")), len(root) + 2, 1 << 30), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.concat(F.lit(root + "/"), F.array_join(F.slice("p", F.lit(1), n), "/")))
    up = state.withColumn("p", parts).where("p[0] <> ''").select("path", "gone", F.explode(ups).alias("folder"))
    kept = F.count_if(F.col("gone").isNull() & (paths.name(F.col("path")) != ".DS_Store"))
    out = up.groupBy("folder").agg(kept.alias("kept"), F.count("gone").alias("moved")).where("kept = 0 and moved > 0")
    return out.select("folder", F.size(F.split("folder", "/")).alias("depth"))
