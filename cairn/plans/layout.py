"""Where every file goes: folders, names without clashes, and what already lies there."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import dates, paths
from cairn.operators.ranks import free_numbers, running
from cairn.session import materialize
from cairn.sources.inventory import CATEGORIES

#: Times that differ by no more are the same.
TOLERANCE_S = 2
#: Statuses, how each is shown, and those that nothing is left to do for.
STATUSES = ("ready", "renamed", "check_first", "already_there", "in_place")
STATUS_TEXT = {"ready": "Ready", "renamed": "Renamed", "check_first": "Check first", "already_there": "Already there", "in_place": "Already sorted"}
SETTLED = ("already_there", "in_place")


@dataclass
class Options:
    """How to lay files out. ``mode`` is how ``pattern`` meets names: contains, exact, wildcard or regex."""

    source: str
    dest: str
    categories: tuple[str, ...] = tuple(CATEGORIES)
    by_type: bool = True
    by_date: bool = True
    date_layout: str = "year_month"
    keep_structure: bool = False
    pattern: str = ""
    mode: str = "contains"
    labels: dict[str, str] = field(default_factory=lambda: {k: v[0] for k, v in CATEGORIES.items()})


def _glob(pattern: str) -> str:
    """A shell wildcard as a Java regex: ``*``, ``?``, ``[seq]`` and ``[!seq]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return rf"(?s)\A{out}\z"


def name_predicate(file_name: Column, pattern: str, mode: str) -> Column:
    """Whether a name meets ``pattern``, whatever its case. An empty pattern meets all."""
    pattern = pattern.strip()
    folded, wanted = paths.folded(file_name), pattern.casefold()
    if not pattern:
        return F.lit(True)
    if mode == "contains":
        return F.contains(folded, F.lit(wanted))
    if mode == "exact":
        stem = F.regexp_replace(folded, r"(?s)(?<=.)\.[^.]+\z", "")
        return (folded == wanted) | (stem == wanted)
    if mode == "wildcard":
        return folded.rlike(_glob(wanted))
    if mode == "regex":
        return file_name.rlike("(?iu)" + pattern)
    raise ValueError(f"no such mode: {mode}")


def pattern_error(spark, pattern: str, mode: str) -> str | None:
    """What is wrong with a regex by Java's rules, or None."""
    if mode != "regex":
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?iu)" + pattern.strip())
    except Exception as e:  # the gateway wraps Java's exception
        return f"Invalid regex: {getattr(e, 'java_exception', e)}"
    return None


def destinations(files: DataFrame, options: Options) -> DataFrame:
    """Selected files with ``dest_folder``: root, type, date and original folder, as the options say.

    ``files`` has path, name, category, size, mtime, and taken or birthtime for dates.
    """
    label = F.element_at(F.create_map(*[F.lit(x) for kv in options.labels.items() for x in kv]), F.col("category"))
    taken = F.col("taken") if "taken" in files.columns else F.lit(None).cast("timestamp")
    when = F.coalesce(taken, dates.file_date(F.col("mtime"), F.col("birthtime")))
    rel_parent = paths.parent(paths.relative(F.col("path"), options.source))
    parts = [F.lit(options.dest)]
    parts += [label] if options.by_type else []
    parts += dates.layout_parts(when, options.date_layout) if options.by_date else []
    if options.keep_structure and options.source != options.dest:
        parts.append(F.when(rel_parent != "", rel_parent))
    chosen = files.where(F.col("category").isin(*options.categories) & name_predicate(F.col("name"), options.pattern, options.mode))
    return chosen.withColumn("dest_folder", F.concat_ws("/", *parts))


class _Root:
    """Names taken under one folder and clash root, and where numbering goes on."""

    def __init__(self):
        self.there: dict[str, tuple[int, int]] = {}
        self.claimed: set[str] = set()
        self.next: dict[tuple[str, str], int] = {}

    def settle(self, name: str, size: int, mtime: int) -> tuple[str, str]:
        """A file's name and status; names once taken stay so, so the numbers below the last one never come free."""
        fold, found = name.casefold(), self.there.get(name.casefold())
        if found and found[0] == size and fold not in self.claimed:
            self.claimed.add(fold)
            return name, "already_there" if abs(found[1] - mtime) <= TOLERANCE_S * 1_000_000 else "check_first"
        final, state = name, "ready"
        if fold in self.there or fold in self.claimed:
            head = re.match(r"(?s)^(\.*[^.].*?|\.*)(\.[^.]*)?$", name)
            stem, ext = head[1], head[2] or ""
            key, state = (stem.casefold(), ext.casefold()), "renamed"
            n = self.next.get(key, 1)
            while (final := f"{stem} ({n}){ext}").casefold() in self.there or final.casefold() in self.claimed:
                n += 1
            self.next[key] = n + 1
        self.claimed.add(final.casefold())
        return final, state


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names and statuses of files, from rows by folder and clash root: what lies there, files in place, the others in scan order."""
    key, root = None, _Root()
    for batch in batches:
        out = []
        columns = [batch[c] for c in ("dest_folder", "root", "turn", "path", "name", "size", "mtime_us", "included")]
        for folder, stem, turn, path, name, size, mtime, included in zip(*columns, strict=True):
            if (folder, stem) != key:
                key, root = (folder, stem), _Root()
            if turn == 0:
                root.there[name.casefold()] = (size, mtime)
            elif turn == 1:
                root.claimed.add(name.casefold())
                out.append((path, name, "in_place"))
            else:
                out.append((path, *(root.settle(name, size, mtime) if included else (name, "ready"))))
        yield pd.DataFrame(out, columns=["path", "dest_name", "status"])


def _alike(rows: DataFrame, at_dest: DataFrame, key: list[str]) -> DataFrame:
    """``_claims``' result for roots whose files all have one name: ``lo``, where ``held`` tells that a file in place has it.

    The name goes to the first file; if it lies at the destination, to the first of the same size instead. All others are
    numbered in order, past the numbers that lie there. Ranks and free numbers are found range by range, so a root may have any number of files.
    """
    there = at_dest.groupBy(*key, F.col("name_fold").alias("lo")).agg(F.min(F.struct("d_size", "d_mtime")).alias("_there"))
    known = rows.join(there, [*key, "lo"], "left")
    wants = F.col("included") & ~F.col("in_place") & ~F.col("held")
    fits = wants & (F.col("_there").isNull() | (F.col("_there.d_size") == F.col("size")))
    first = known.where(fits).groupBy(*key).agg(F.min(F.struct("ord", "name", "path")).alias("_first"))
    met = materialize(known.join(first, key, "left").withColumn("wins", F.coalesce(F.col("_first.path") == F.col("path"), F.lit(False))), "claims")
    late = F.abs(F.col("_there.d_mtime") - F.col("mtime_us")) <= TOLERANCE_S * 1_000_000
    kept = met.where("in_place or not included or wins")
    state = F.when(F.col("in_place"), "in_place").when(~F.col("included") | F.col("_there").isNull(), "ready").when(late, "already_there").otherwise("check_first")
    numbered = met.where("not in_place and included and not wins").select(*key, "ord", "name", "path")
    taken = _numbers(at_dest, F.col("name_fold"), *key).withColumnRenamed("base", "lo").join(rows.select(*key, "lo").distinct(), [*key, "lo"], "left_semi")
    dealt = free_numbers(numbered, taken.select(*key, "number"), key, ["ord", "name", "path"])
    return kept.select("path", F.col("name").alias("dest_name"), state.alias("status")).unionByName(dealt.select("path", paths.numbered(F.col("name"), F.col("number")).alias("dest_name"), F.lit("renamed").alias("status")))


def _numbers(df: DataFrame, name: Column, *keep: str) -> DataFrame:
    """``keep``, ``number`` and ``base`` of the names that end in a number as ``paths.numbered`` writes it; base is the folded name without it."""
    ending = r"(?s) \((\d{1,9})\)$"
    number = F.regexp_extract(paths.stem(name), ending, 1)
    base = paths.folded(F.concat(F.regexp_replace(paths.stem(name), ending, ""), paths.extension(name)))
    return df.select(*keep, base.alias("base"), number.alias("number")).where("number <> '' and number not like '0%'").withColumn("number", F.col("number").cast("long"))


def _mixed(rows: DataFrame, at_dest: DataFrame, key: list[str]) -> DataFrame:
    """``_claims`` over roots with several names, which may take each other's numbers: in order, a root at a time."""
    ours = rows.select(*key, F.when(F.col("in_place"), 1).otherwise(2).alias("turn"), "ord", "path", "name", "size", "mtime_us", "included")
    near = at_dest.join(ours.select(*key).distinct(), key, "left_semi")
    near = near.select(*key, F.lit(0).alias("turn"), F.lit("").alias("ord"), F.lit("").alias("path"), F.col("name_fold").alias("name"), F.col("d_size").alias("size"), F.col("d_mtime").alias("mtime_us"), F.lit(False).alias("included"))
    in_line = ours.unionByName(near).repartition(*key).sortWithinPartitions(*key, "turn", "ord", "name")
    return in_line.mapInPandas(_claims, "path string, dest_name string, status string")


def plan(files: DataFrame, dest_files: DataFrame, options: Options, excluded: DataFrame | None = None) -> DataFrame:
    """``files`` with dest_folder, dest_name, dest, status, included and actionable.

    ``dest_files`` has (folder, name, size, mtime), ``excluded`` paths that stay in the plan but claim
    no name. In scan order the first claims its name, later ones get the least free number; names
    meet regardless of case. Names that only differ by numbering share a clash root; those of
    different roots never meet, so roots are decided apart. A root with one name, however many files have it, is
    numbered by ranks; one with several names goes through one Python pass over rows sorted by root,
    which holds one root's names at a time.
    """
    placed = destinations(files, options)
    out = excluded.select(F.col("path").alias("_out")).distinct() if excluded is not None else None
    placed = placed.join(out, F.col("path") == F.col("_out"), "left").withColumn("included", F.col("_out").isNull()).drop("_out") if out is not None else placed.withColumn("included", F.lit(True))
    keyed = placed.select(
        "path", "name", "size", F.unix_micros("mtime").alias("mtime_us"), "dest_folder", "included",
        paths.scan_order(F.col("path")).alias("ord"), paths.clash_root(F.col("name")).alias("root"),
        (F.concat_ws("/", "dest_folder", "name") == F.col("path")).alias("in_place"), paths.folded(F.col("name")).alias("fold"),
    )
    key = ["dest_folder", "root"]
    at_dest = dest_files.select(F.col("folder").alias("dest_folder"), paths.clash_root(F.col("name")).alias("root"), paths.folded(F.col("name")).alias("name_fold"), F.col("size").alias("d_size"), F.unix_micros("mtime").alias("d_mtime"))
    keyed = materialize(keyed, "keyed")  # read several times from here on
    groups = keyed.groupBy(*key).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.max("in_place").alias("held"))
    marked = materialize(keyed.join(groups.select(*key, (F.col("lo") != F.col("hi")).alias("knotty"), "lo", "held"), key), "marked")
    named = _alike(marked.where("not knotty"), at_dest, key).unionByName(_mixed(marked.where("knotty"), at_dest, key))
    done = placed.join(named, "path")
    dest = F.when(F.col("status") == "in_place", F.col("path")).otherwise(F.concat_ws("/", "dest_folder", "dest_name"))
    return done.withColumn("dest", dest).withColumn("actionable", F.col("included") & ~F.col("status").isin("in_place", "already_there"))


def plan_summary(planned: DataFrame) -> DataFrame:
    """One row of counts over the plan."""
    count = lambda cond, name: F.count_if(cond).alias(name)
    act, status = F.col("actionable"), F.col("status")
    return planned.agg(
        F.count(F.lit(1)).alias("planned"), count(act, "actionable"), F.coalesce(F.sum(F.when(act, F.col("size"))), F.lit(0)).alias("bytes"),
        count(act & (status == "renamed"), "renamed"), count(act & (status == "check_first"), "check_first"),
        count(status.isin("already_there", "in_place"), "already_there"), count(~F.col("included") & ~status.isin(*SETTLED), "unticked"),
    )


def status_text(included: Column, status: Column) -> Column:
    text = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_TEXT.items() for x in kv]), status)
    return F.when(~included & ~status.isin(*SETTLED), "Skipped").otherwise(text)


def relative_dest(dest_folder: Column, file_name: Column, dest_name: Column, root: str) -> Column:
    """The folder below the root, with the name where it changes."""
    folder = F.when(dest_folder == root, "").otherwise(F.substring(dest_folder, len(root) + 2, 1 << 30))
    shown = F.when(file_name != dest_name, F.concat_ws("/", F.when(folder != "", folder), dest_name)).otherwise(folder)
    return F.when(shown == "", "(top level)").otherwise(shown)


def search(planned: DataFrame, needle: str) -> DataFrame:
    """Rows whose name, destination or path has ``needle``, whatever its case."""
    wanted = F.lit(needle.casefold())
    has = lambda column: F.contains(paths.folded(F.col(column)), wanted)
    return planned.where(has("name") | has("dest") | has("path"))


def sorted_plan(planned: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """By name, size, date (``mtime``), dest or status; ties by path."""
    column = {"name": F.lower("name"), "size": F.col("size"), "date": F.col("mtime"), "dest": F.lower("dest"), "status": F.col("status")}[by]
    return planned.orderBy(column.desc() if descending else column.asc(), "path")


def example(planned: DataFrame, category: str | None = None) -> DataFrame:
    """The first planned file in scan order, of ``category`` if one is chosen."""
    chosen = planned if category is None else planned.where(F.col("category") == category)
    return chosen.orderBy(paths.scan_order(F.col("path")), "name").limit(1)


def checked_plan(files: DataFrame, dest_files: DataFrame, options: Options, excluded: DataFrame | None = None) -> tuple[DataFrame, str | None]:
    """``plan``'s rows, and what is wrong with the name pattern: then the plan is empty."""
    error = pattern_error(files.sparkSession, options.pattern, options.mode)
    if error:
        return plan(files.limit(0), dest_files, replace(options, pattern=""), excluded), error
    return plan(files, dest_files, options, excluded), None


def folders_to_create(planned: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Folders below ``root`` that a run must make: ancestors of destinations that don't exist (column ``folder``)."""
    parts = F.split(F.substring(paths.parent(F.col("dest")), len(root) + 2, 1 << 30), "/")
    below = planned.where("actionable").select(parts.alias("p")).where("p[0] <> ''").distinct()
    every = below.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.concat(F.lit(root + "/"), F.array_join(F.slice("p", F.lit(1), n), "/")))).alias("folder"))
    return every.distinct().join(existing.select("folder"), "folder", "left_anti")


def reconcile(planned: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """What a run does with each actionable row: ``outcome`` of transferred, skipped, renamed or failed, and ``final``.

    ``source`` and ``dest`` have (path, digest) as they are now. Equal content at the destination is
    skipped, other content is written beside it: final is its destination, or that under the least number
    that is free, dealt in order of path. It is null where nothing is written.
    """
    now = planned.where("actionable").join(source.select("path", F.col("digest").alias("s")), "path", "left")
    met = now.join(dest.select(F.col("path").alias("dest"), F.col("digest").alias("d")), "dest", "left")
    outcome = F.when(F.col("s").isNull(), "failed").when(F.col("d").isNull(), "transferred").when(F.col("s") == F.col("d"), "skipped").otherwise("renamed")
    told = met.withColumn("outcome", outcome).drop("s", "d").withColumn("_folder", paths.parent(F.col("dest"))).withColumn("_name", paths.name(F.col("dest")))
    told = materialize(told.withColumn("_base", paths.folded(F.col("_name"))), "outcomes")
    # numbers taken: of names that lie there, or that other rows go to
    taken = dest.select("path").union(told.select(F.col("dest").alias("path"))).select(paths.parent(F.col("path")).alias("_folder"), paths.name(F.col("path")).alias("_n"))
    numbers = _numbers(taken, F.col("_n"), "_folder").withColumnRenamed("base", "_base")
    clash = told.where("outcome = 'renamed'")
    numbers = numbers.join(clash.select("_folder", "_base").distinct(), ["_folder", "_base"], "left_semi")
    dealt = free_numbers(clash, numbers, ["_folder", "_base"], ["path"])
    renamed = F.concat_ws("/", F.when(F.col("_folder") != "", F.col("_folder")), paths.numbered(F.col("_name"), F.col("number")))
    straight = told.where("outcome <> 'renamed'").withColumn("final", F.when(F.col("outcome") == "transferred", F.col("dest")))
    return straight.unionByName(dealt.withColumn("final", renamed).drop("number")).drop("_folder", "_name", "_base")


def ledger_events(reconciled: DataFrame) -> DataFrame:
    """What a run writes down of ``reconciled``: ``(seq, type, src, dst, size)``, a file event for each row that is written, by path; 1 is the header's number."""
    written = reconciled.where("final is not null").select(F.lit(0).alias("_all"), F.col("path").alias("src"), F.col("final").alias("dst"), "size")
    numbered = running(written, ["_all"], ["src"])
    return numbered.select((F.col("rank") + 1).alias("seq"), F.lit("file").alias("type"), "src", "dst", "size")


def progress(planned: DataFrame) -> DataFrame:
    """Files and bytes done before each actionable file, in scan order.

    Rows are dealt into ranges of that order; sums of whole ranges come first, so no task holds all rows.
    """
    order = [paths.scan_order(F.col("path")), "name", "path"]
    act = planned.where("actionable").select("path", "name", "size", F.lit(0).alias("_all"))
    counted = running(running(act, ["_all"], order, name="_files"), ["_all"], order, F.col("size"), "_bytes")
    return counted.select("path", "size", (F.col("_files") - 1).alias("files_before"), (F.col("_bytes") - F.coalesce("size", F.lit(0))).alias("bytes_before"))
