"""The file-inventory operators as queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import bits, dates, paths, windows
from cairn.operators import components, exact, groups, hamming, ledger, partial, ranks, report, review
from cairn.plans import layout, views
from cairn.session import counted_side, materialize, scratch_path
from cairn.sources import inventory, journals, store
from cairn.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Now, for dates that lie too far ahead.
YEAR = 2024
OPTIONS = layout.Options(source="/lib", dest="/sorted")
STAMP, DUCK_STAMP = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


FILES = f"with files as ({views.DUCK_FILES})"
NAMED = f"{FILES}, exts as ({views.DUCK_EXTENSIONS}), named as ({views.DUCK_NAMED})"
FOLDED = """
     dated as (select *, least(mtime, coalesce(birthtime, mtime)) as best from named),
     placed as (select *, '/sorted/' || label || '/' || strftime(best, '%Y') || '/' || strftime(best, '%Y-%m') as dest_folder from dated),
     at_dest as (select dest_folder as folder, lower(name) as fold, size + (file_id % 16 = 12)::int as d_size,
                        mtime + case file_id % 16 when 4 then INTERVAL '1' SECOND when 8 then INTERVAL '1' HOUR else INTERVAL '0' SECOND end as d_mtime
                 from placed where file_id % 4 = 0 qualify row_number() over (partition by dest_folder, lower(name) order by file_id) = 1),
     met as (select p.*, d_size, d_mtime, list_transform(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x) as parts
             from placed p left join at_dest on folder = dest_folder and fold = lower(name)),
     hit as (select *, case when d_size = size then row_number() over (partition by dest_folder, lower(name), d_size = size order by parts, name) end as nth from met),
     won as (select *, coalesce(nth, 0) = 1 as same from hit),
     ranked as (select *, row_number() over (partition by dest_folder, lower(name), same order by parts, name) - case when d_size is null then 1 else 0 end as n from won),
     planned as (select *, case when same and abs(epoch(d_mtime) - epoch(mtime)) <= 2 then 'already_there' when same then 'check_first' when n = 0 then 'ready' else 'renamed' end as status,
                        case when same or n = 0 then name else regexp_extract(name, '^(.*)(\\.[^.]*)$', 1) || ' (' || n || ')' || regexp_extract(name, '^(.*)(\\.[^.]*)$', 2) end as dest_name from ranked)"""
PLANNED = f"{NAMED},{FOLDED}"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.classify(views.files(spark, sf_dir).drop("content"))


def _dest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies at the destination: of every fourth file a copy, some a second or an hour later, some a byte longer."""
    placed = layout.destinations(_classified(spark, sf_dir), OPTIONS).where("file_id % 4 = 0")
    late = F.expr("case file_id % 16 when 4 then interval '1' second when 8 then interval '1' hour else interval '0' second end")
    copy = F.struct("name", (F.col("size") + (F.col("file_id") % 16 == 12).cast("long")).alias("size"), (F.col("mtime") + late).alias("mtime"))
    one = placed.groupBy(F.col("dest_folder").alias("folder"), F.lower("name").alias("fold")).agg(F.min_by(copy, "file_id").alias("c"))
    return one.select("folder", "c.*")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan(_classified(spark, sf_dir), _dest_files(spark, sf_dir), OPTIONS)


# Inventory


@query(f"{NAMED}, every as (select distinct category, label from exts union all select 'other', 'Other') select category, label, count(path) as n from every left join (select category, path from named) using (category) group by all")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.category_counts(_classified(spark, sf_dir))


@query(f"{FILES} select count(*) as files, coalesce(sum(size), 0)::bigint as bytes from files")
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.totals(views.files(spark, sf_dir))


@query(f"{FILES} select path, path[6:] as rel, size from files where file_id % 10 > 4")
def scan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.scan(views.listing(spark, sf_dir), "/lib", exclude="/lib/sorted").select("path", "rel", "size")


@query(f"{FILES} select path, row_number() over (partition by string_split(path, '/')[3] order by string_split(regexp_replace(path, '/[^/]*$', ''), '/'), regexp_replace(path, '^.*/', '')) as position from files")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's place in its source's scan order."""
    placed = views.files(spark, sf_dir).select("path", F.split("path", "/")[2].alias("source"))
    return ranks.running(placed, ["source"], [paths.scan_order(F.col("path")), paths.name(F.col("path"))], name="position").select("path", "position")


@query(f"{FILES}, more as (select * from files where file_id % 2 = 0) select path, max(size) as size from (select path, size from files where file_id % 3 <> 0 union all select path, size from more) group by path")
def union_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views.files(spark, sf_dir).select("path", "size", "file_id")
    return inventory.union_roots(every.where("file_id % 3 <> 0").drop("file_id"), every.where("file_id % 2 = 0").drop("file_id"))


@query(f"{FILES} select path from files where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ({', '.join(repr(e) for e in inventory.DECODABLE)})")
def decodable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.decodable(views.files(spark, sf_dir)).select("path")


# Dates

_FROM_TAG = "case when year(try_strptime(substr({0}, 1, 19), '%Y:%m:%d %H:%M:%S')) between 1971 and 2025 then try_strptime(substr({0}, 1, 19), '%Y:%m:%d %H:%M:%S') end"


@query(f"""{NAMED}, tags as ({views.DUCK_TAGS}), x as (select t.*, category, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as ext from tags t join named using (file_id, path)),
taken as (select *, case when ext in ('.mov', '.mp4') then case when seconds > 0 then make_timestamp((seconds - 2082844800) * 1000000) end
                         when category = 'photos' then coalesce({_FROM_TAG.format('original')}, {_FROM_TAG.format('digitized')}) end as t from x)
select file_id, strftime(t, '{DUCK_STAMP}') as taken, case when t is null then 'file' when category = 'photos' then 'photo' else 'video' end as date_source from taken""")
def capture_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = inventory.classify(views.tags(spark, sf_dir).drop("mtime", "birthtime"))
    c = dates.capture(F.col("category"), F.col("ext"), F.col("original"), F.col("digitized"), F.col("datetime"), F.col("seconds"), YEAR)
    return tagged.select("file_id", c.alias("c")).select("file_id", F.date_format("c.taken", STAMP).alias("taken"), "c.date_source")


@query(f"{FILES}, x as (select file_id, least(mtime, coalesce(birthtime, mtime)) as d from files) select file_id, strftime(d, '%Y') as by_year, strftime(d, '%Y/%Y-%m') as by_month, strftime(d, '%Y/%Y-%m/%Y-%m-%d') as by_day, strftime(d, '%Y-%m') as flat from x")
def date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = dates.file_date(F.col("mtime"), F.col("birthtime"))
    names = ("by_year", "by_month", "by_day", "flat")
    return views.files(spark, sf_dir).select("file_id", *[F.concat_ws("/", *dates.layout_parts(when, k)).alias(n) for k, n in zip(dates.LAYOUTS, names, strict=True)])


@query(f"{NAMED} select path from named where category in ('photos', 'videos', 'pdfs') and (file_id % 4 = 0 or file_id % 7 = 0 or file_id % 9 = 0)")
def pending_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media and PDFs without a date: never dated, dated before a change, or tried in vain."""
    every = _classified(spark, sf_dir)
    changed = F.when(F.col("file_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    dated = every.where("file_id % 4 > 0").select("path", changed.alias("size"), "mtime", F.when(F.col("file_id") % 9 > 0, F.lit("photo")).alias("date_source"))
    return inventory.pending_dates(every, dated, ("photos", "videos", "pdfs")).select("path")


# Name filters

_URLS = "with n as (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') || '.Html' as name from pages) select page_id, name from n where "


def _names(pattern: str, mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.url_names(spark, sf_dir).where(layout.name_predicate(F.col("name"), pattern, mode))

    return run


for _mode, _pattern, _where in (
    ("contains", " 5.hT ", "contains(lower(name), '5.ht')"),
    ("exact", "825", "lower(name) in ('825', '825.html') and (lower(name) = '825' or regexp_replace(lower(name), '\\.[^.]+$', '') = '825')"),
    ("wildcard", "[!1-4]?5.h*", "regexp_full_match(lower(name), '[^1-4].5\\.h.*')"),
    ("regex", r"^\d{2}\.HTML", "regexp_matches(name, '(?i)^\\d{2}\\.HTML')"),
):
    QUERIES[f"name_{_mode}"] = _names(_pattern, _mode)
    ORACLES[f"name_{_mode}"] = _URLS + _where


# Plan


@query(f"{NAMED},{FOLDED} select path, dest_folder from placed where category <> 'data'")
def plan_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = layout.Options(source="/lib", dest="/sorted", categories=tuple(c for c in inventory.CATEGORIES if c != "data"))
    return layout.destinations(_classified(spark, sf_dir), options).select("path", "dest_folder")


@query(f"{PLANNED} select path, dest_folder || '/' || dest_name as dest, status, status <> 'already_there' as actionable from planned")
def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("path", "dest", "status", "actionable")


@query(f"""{PLANNED}, a as (select *, status <> 'already_there' as act from planned)
select count(*) as planned, count(*) filter (act) as actionable, coalesce(sum(size) filter (act), 0)::bigint as bytes, count(*) filter (act and status = 'renamed') as renamed,
       count(*) filter (act and status = 'check_first') as check_first, count(*) filter (status = 'already_there') as already_there, 0::bigint as unticked from a""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_summary(_plan(spark, sf_dir))


@query(f"{PLANNED} select path, dest_folder || '/' || dest_name as dest from planned where contains(lower(path || '|' || dest_folder || '/' || dest_name), '-07/doc_1')")
def plan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.search(_plan(spark, sf_dir), "-07/DOC_1").select("path", "dest")


@query(f"{PLANNED} select path, case when name <> dest_name then dest_folder[9:] || '/' || dest_name else dest_folder[9:] end as shown, case status when 'ready' then 'Ready' when 'renamed' then 'Renamed' when 'check_first' then 'Check first' else 'Already there' end as state from planned order by lower(name), path limit 100")
def plan_sorted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = layout.sorted_plan(_plan(spark, sf_dir), "name").limit(100)
    return top.select("path", layout.relative_dest(F.col("dest_folder"), F.col("name"), F.col("dest_name"), "/sorted").alias("shown"), layout.status_text(F.col("included"), F.col("status")).alias("state"))


_SORTS = {"size": ("size", False), "date": ("mtime", False), "dest": ("lower(dest_folder || '/' || dest_name)", False), "status": ("status", True)}


def _sorted(by: str, descending: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return layout.sorted_plan(_plan(spark, sf_dir), by, descending).limit(100).select("path", "dest")

    return run


for _by, (_column, _down) in _SORTS.items():
    QUERIES[f"plan_sorted_by_{_by}"] = _sorted(_by, _down)
    ORACLES[f"plan_sorted_by_{_by}"] = f"{PLANNED} select path, dest_folder || '/' || dest_name as dest from planned order by {_column}{' desc' if _down else ''}, path limit 100"

_EXCLUDED = PLANNED.replace("from placed p left join at_dest", "from (select * from placed where file_id % 6 > 0) p left join at_dest") + """,
     every as (select path, size, dest_folder || '/' || dest_name as dest, status, true as included from planned union all select path, size, dest_folder || '/' || name, 'ready', false from placed where file_id % 6 = 0)"""


def _plan_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _classified(spark, sf_dir)
    return layout.plan(every, _dest_files(spark, sf_dir), OPTIONS, every.where("file_id % 6 = 0").select("path"))


@query(f"""{_EXCLUDED} select path, dest, status, included and status <> 'already_there' as actionable,
case when status = 'already_there' then 'Already there' when not included then 'Skipped' when status = 'renamed' then 'Renamed' when status = 'check_first' then 'Check first' else 'Ready' end as state from every""")
def plan_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_excluded(spark, sf_dir).select("path", "dest", "status", "actionable", layout.status_text(F.col("included"), F.col("status")).alias("state"))


@query(f"{_EXCLUDED} select count(*) as planned, count(*) filter (included and status <> 'already_there') as actionable, count(*) filter (not included and status <> 'already_there') as unticked, count(*) filter (status = 'already_there') as already_there from every")
def plan_summary_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan_summary(_plan_excluded(spark, sf_dir)).select("planned", "actionable", "unticked", "already_there")


@query(f"{PLANNED} select path, dest_folder || '/' || dest_name as dest from planned where category = 'videos' order by list_transform(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x), name limit 1")
def plan_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.example(_plan(spark, sf_dir), "videos").select("path", "dest")


@query(f"{NAMED} select '(' as pattern, 0::bigint as planned, true as failed union all select '^doc_1', count(*) filter (regexp_matches(name, '(?i)^doc_1')), false from named")
def plan_bad_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by two patterns, of which one is no regex."""
    every, there, rows = _classified(spark, sf_dir), _dest_files(spark, sf_dir), []
    for pattern in ("(", "^doc_1"):
        planned, error = layout.checked_plan(every, there, layout.Options(source="/lib", dest="/sorted", pattern=pattern, mode="regex"))
        rows.append(planned.agg(F.lit(pattern).alias("pattern"), F.count(F.lit(1)).alias("planned"), F.lit(error is not None).alias("failed")))
    return rows[0].unionByName(rows[1])


@query(f"{FILES} select path from files where (file_id % 5 = 0 and not starts_with(path, '/lib/src1/')) or (file_id % 7 = 0 and starts_with(path, '/lib/src1/'))")
def exclusion_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays excluded when the files below one folder are shown and some of these are unticked."""
    every = views.files(spark, sf_dir).select("file_id", "path")
    shown = every.where("path like '/lib/src1/%'")
    return review.exclusions(every.where("file_id % 5 = 0").select("path"), shown.select("path"), shown.where("file_id % 7 = 0").select("path"))


@query(f"""{PLANNED}, p as (select distinct unnest([dest_folder[:len(dest_folder)], regexp_replace(dest_folder, '/[^/]*$', ''), regexp_replace(dest_folder, '/[^/]*/[^/]*$', '')]) as folder from planned where status <> 'already_there')
select folder from p where folder not in (select distinct folder from at_dest)""")
def created_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.folders_to_create(_plan(spark, sf_dir), _dest_files(spark, sf_dir).select("folder").distinct(), "/sorted")


@query(f"""{PLANNED}, act as (select *, row_number() over (order by list_transform(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x), name, path) as k from planned where status <> 'already_there')
select path, size, count(*) over w as files_before, coalesce(sum(size) over w, 0)::bigint as bytes_before from act window w as (order by k rows between unbounded preceding and 1 preceding)""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.progress(_plan(spark, sf_dir))


_RESULTS = f"""{PLANNED}, act as (select *, dest_folder || '/' || dest_name as dest, regexp_extract(dest_name, '^(.*)(\\.[^.]*)$', 1) as stem, regexp_extract(dest_name, '^(.*)(\\.[^.]*)$', 2) as ext from planned where status <> 'already_there'),
there as (select dest as path, case when file_id % 2 = 0 then sha256(content) else 'other' end as digest from act where file_id % 5 = 0
  union all select dest_folder || '/' || stem || ' (2)' || ext, 'other' from act where file_id % 10 = 5
  union all select dest_folder || '/' || stem || ' (1)' || ext, 'other' from act where file_id % 20 = 5 and dest_folder || '/' || stem || ' (1)' || ext not in (select dest from act)),
now as (select act.*, case when file_id % 9 = 0 then null else sha256(content) end as s, d.digest as d from act left join there d on d.path = dest),
told as (select *, case when s is null then 'failed' when d is null then 'transferred' when s = d then 'skipped' else 'renamed' end as outcome from now),
taken as (select distinct lower(path) as p from (select path from there union all select dest from act)),
free as (select path, min(n) as n from (select t.path, dest_folder, stem, ext, unnest(range(1, 12)) as n from told t where outcome = 'renamed') where lower(dest_folder || '/' || stem || ' (' || n || ')' || ext) not in (select p from taken) group by path),
results as (select told.path, size, outcome, case outcome when 'transferred' then dest when 'renamed' then dest_folder || '/' || stem || ' (' || free.n || ')' || ext end as final from told left join free using (path))"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan met with what both sides hold now: at every fifth destination equal or other content, at some also numbered names; every ninth file is gone."""
    digests = materialize(views.files(spark, sf_dir).select("path", (F.col("file_id") % 9 == 0).alias("gone"), F.sha2(F.col("content").cast("binary"), 256).alias("digest")), "digests")
    planned = materialize(_plan(spark, sf_dir), "plan")
    met = materialize(planned.where("actionable").join(digests, "path").select("file_id", "dest", "dest_folder", "dest_name", "digest"), "met")
    own = met.where("file_id % 5 = 0").select(F.col("dest").alias("path"), F.when(F.col("file_id") % 2 == 0, F.col("digest")).otherwise("other").alias("digest"))
    name = lambda n: F.concat_ws("/", "dest_folder", paths.numbered(F.col("dest_name"), F.lit(n))).alias("path")
    second = met.where("file_id % 10 = 5").select(name(2), F.lit("other").alias("digest"))
    first = met.where("file_id % 20 = 5").select(name(1), F.lit("other").alias("digest")).join(met.select(F.col("dest").alias("path")), "path", "left_anti")
    left = digests.where("not gone").select("path", "digest")
    return layout.reconcile(planned, left, own.unionByName(second).unionByName(first))


@query(f"{_RESULTS} select path, outcome, final from results")
def reconcile_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the plan does with each file, and where it ends up."""
    return _reconciled(spark, sf_dir).select("path", "outcome", "final")


@query(f"{_RESULTS} select row_number() over (order by path) + 1 as seq, 'file' as type, path as src, final as dst, size from results where final is not null")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that such a run writes down."""
    return layout.ledger_events(_reconciled(spark, sf_dir))


# Exact copies

_COPIES = f"{FILES}, x as (select *, sha256(content) as digest from files), m as (select *, count(*) over (partition by digest) as n, row_number() over (partition by digest order by size desc, mtime, length(path), path) as rank from x qualify n > 1)"


@query(f"{_COPIES} select path, digest, rank, rank = 1 as keep from m")
def exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_members(views.files(spark, sf_dir)).select("path", "digest", F.col("rank").cast("long").alias("rank"), "keep")


@query(f"{_COPIES} select max(path) filter (rank = 1) as keeper, count(*) as copies, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable from m group by digest")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(views.files(spark, sf_dir))


@query(f"{_COPIES} select count(distinct digest) as groups, count(*) filter (rank > 1) as extra_copies, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable from m")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(exact.exact_groups(views.files(spark, sf_dir)))


_SPOILT = f"{FILES}, y as (select * replace (case when file_id % 29 > 0 then content end as content) from files), x as (select *, sha256(content) as digest from y where content is not null), m as (select *, count(*) over (partition by digest) as n, row_number() over (partition by digest order by size desc, mtime, length(path), path) as rank from x qualify n > 1)"


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which every 29th can't be read."""
    return views.files(spark, sf_dir).withColumn("content", F.when(F.col("file_id") % 29 > 0, F.col("content")))


@query(f"{_SPOILT} select (select count(*) from y) as scanned, (select count(*) from y where content is null) as unreadable, count(distinct digest) as groups, count(*) filter (rank > 1) as extra_copies, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable from m")
def duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.totals(_spoilt(spark, sf_dir))


@query(f"{_SPOILT} select path, size from y where content is null")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.unreadable(_spoilt(spark, sf_dir)).select("path", "size")


@query(f"{_COPIES} select max(path) filter (rank = 1) as keeper, count(*) as copies, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable from m group by digest order by reclaimable desc, keeper limit 30")
def group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.group_page(exact.exact_groups(views.files(spark, sf_dir)), 0)


# Similar signatures

_ITEMS = f"with recursive items as materialized ({views.DUCK_SIGNATURES})"
_CLASSES = f"{_ITEMS}, classes as (select *, min(item_id) over (partition by phash, dhash, width, height) as class_id from items), reps as (select * from classes where item_id = class_id)"
_LINKS = f"""{_CLASSES}, near as (select a.item_id as a, b.item_id as b from reps a join reps b on a.item_id < b.item_id and bit_count(xor(a.phash, b.phash)) <= 14 and bit_count(xor(a.dhash, b.dhash)) <= 20 and a.width = b.width),
links as (select a, b from near union all select class_id, item_id from classes where item_id <> class_id union all select x.item_id, y.item_id from (select min(item_id) as item_id from items where digest = 'same') x, items y where y.digest = 'same' and y.item_id > x.item_id),
ends as (select a, b from links union select b, a from links), walk(node, low) as (select a, a from ends union select b, low from walk join ends on node = a), labels as (select node, min(low) as component from walk group by node)"""


def _near(level: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hamming.hamming_pairs(views.signatures(spark, sf_dir), level)

    return run


for _level, (_p, _d) in hamming.LEVELS.items():
    QUERIES[f"hamming_pairs_{_level}"] = _near(_level)
    ORACLES[f"hamming_pairs_{_level}"] = f"{_CLASSES} select a.item_id as a, b.item_id as b from reps a join reps b on a.item_id < b.item_id and bit_count(xor(a.phash, b.phash)) <= {_p} and bit_count(xor(a.dhash, b.dhash)) <= {_d} and greatest(a.width, b.width) / least(a.width, b.width) < 1.08"


@query(f"{_CLASSES} select item_id, class_id from classes")
def signature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.signature_classes(views.signatures(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near signatures at the loose level, copies of a signature, and equal digests."""
    items = views.items(spark, sf_dir)
    near = hamming.hamming_pairs(items, "loose")
    copies = hamming.signature_classes(items).where("item_id <> class_id").select(F.col("class_id").alias("a"), F.col("item_id").alias("b"))
    first = items.groupBy("digest").agg(F.min("item_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = items.join(counted_side(materialize(first, "same-digest"), 128), "digest").where("item_id <> a").select("a", F.col("item_id").alias("b"))
    return materialize(near.union(copies).union(same), "links")


@query(f"{_LINKS} select node, component from labels")
def components_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(_links(spark, sf_dir))


_MEMBERS = f"""{_LINKS}, m as (select component as group_id, i.*, width * height as pixels, row_number() over (partition by component order by width * height desc, size desc, item_id % 1000000000, length(path), path) as rank from items i join labels on node = item_id),
k as (select group_id, width as k_width, pixels as k_pixels, digest as k_digest from m where rank = 1),
r as (select *, case when rank = 1 then 'keeper' when digest = k_digest then 'exact' when pixels < 0.9 * k_pixels then 'smaller' else 'similar' end as relation from m join k using (group_id))"""


@query(f"""{_MEMBERS} select group_id, item_id, rank, relation, case when relation = 'smaller' then width / k_width end as share from r""")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.members(views.items(spark, sf_dir), _links(spark, sf_dir))
    return found.select("group_id", "item_id", F.col("rank").cast("long").alias("rank"), "relation", "share")


@query(f"{_MEMBERS} select group_id, case when bool_and(relation = 'exact') filter (rank > 1) then 'Exact copies' else 'Near-duplicates' end as title, count(*) as members, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable, max(path) filter (rank = 1) as keeper from r group by group_id")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summaries(groups.members(views.items(spark, sf_dir), _links(spark, sf_dir)))


_CROPS = f"""{_LINKS}, crops as (select a, b, ((a + b) % 7) / 8.0 + 0.125 as of_a, ((a * 3 + b) % 8) / 8.0 + 0.125 as of_b from links where (a + b) % 3 > 0),
m as (select component as group_id, i.*, width * height as pixels, row_number() over (partition by component order by width * height desc, size desc, item_id % 1000000000, length(path), path) as rank from items i join labels on node = item_id),
k as (select group_id, item_id as keeper, width as k_width, pixels as k_pixels, digest as k_digest from m where rank = 1),
e as (select a as keeper, b as item_id, of_a as mine, of_b as theirs from crops union all select b, a, of_b, of_a from crops),
r as (select *, case when rank = 1 then 'keeper' when digest = k_digest then 'exact' when mine < 0.9 and theirs >= 0.85 then 'cropped' when theirs < 0.9 and mine >= 0.85 then 'contains' when pixels < 0.9 * k_pixels then 'smaller' else 'similar' end as relation from m join k using (group_id) left join e using (keeper, item_id))"""


def _crops(links: DataFrame) -> DataFrame:
    """Evidence for two links of three."""
    share = lambda c: (F.expr(c) % 8) / F.lit(8.0) + 0.125
    return links.where("(a + b) % 3 > 0").select("a", "b", ((F.col("a") + F.col("b")) % 7 / F.lit(8.0) + 0.125).alias("coverage_of_a"), share("a * 3 + b").alias("coverage_of_b"))


def _cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return groups.members(views.items(spark, sf_dir), links, _crops(links))


@query(f"{_CROPS} select group_id, item_id, rank, relation, case relation when 'cropped' then mine when 'smaller' then width / k_width end as share from r")
def cropped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cropped(spark, sf_dir).select("group_id", "item_id", F.col("rank").cast("long").alias("rank"), "relation", "share")


@query(f"{_CROPS} select group_id, case when bool_and(relation = 'exact') filter (rank > 1) then 'Exact copies' when bool_or(relation in ('cropped', 'contains')) filter (rank > 1) then 'Includes cropped versions' else 'Near-duplicates' end as title, count(*) as members from r group by group_id")
def cropped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summaries(_cropped(spark, sf_dir)).select("group_id", "title", "members")


_GRID = f"""with e as (select vec_id, list_transform(embedding[1:64], lambda x: x::double) as e from embeddings),
w as (select list_transform(range(8), lambda k: list_transform(range(32), lambda i: cos(pi() * (2 * i + 1) * k / 64) * sqrt(2.0 / 32) / case when k = 0 then sqrt(2.0) else 1 end)) as w),
u as (select vec_id, e, list_transform(w, lambda k: list_sum(list_transform(range(1, 33), lambda i: k[i] * e[i]))) as a, list_transform(w, lambda k: list_sum(list_transform(range(1, 33), lambda i: k[i] * e[32 + i]))) as b from e, w),
low as (select vec_id, e, list_transform(range(64), lambda n: a[n // 8 + 1] * b[n % 8 + 1]) as low from u),
med as (select *, list_sort(low[2:64])[32] as m, list_concat(e, e[1:8]) as v from low)"""


@query(f"""{_GRID} select vec_id as item_id, list_aggregate(list_transform(low, lambda x: case when x > m then '1' else '0' end), 'string_agg', '') as phash,
list_aggregate(list_transform(range(64), lambda n: case when v[(n // 8) * 9 + n % 8 + 2] > v[(n // 8) * 9 + n % 8 + 1] then '1' else '0' end), 'string_agg', '') as dhash,
sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64 - power(list_sum(e) / 64, 2)) < 0.12 as flat from med""")
def grid_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both signatures and flatness from grids: 32 x 32 values are products of an embedding's halves, 9 x 8 its values in rows."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double")).alias("e"))
    grid = F.flatten(F.transform(F.slice("e", 1, 32), lambda x: F.transform(F.slice("e", 33, 32), lambda y: x * y)))
    low = bits.with_low_frequencies(e.select("vec_id", "e", grid.alias("grid")), "grid")
    shown = lambda c: F.lpad(F.bin(c), 64, "0")
    rows = F.concat("e", F.slice("e", 1, 8))
    return low.select(F.col("vec_id").alias("item_id"), shown(bits.frequency_signature(F.col("low"))).alias("phash"), shown(bits.row_gradient_signature(rows)).alias("dhash"), bits.is_flat(F.col("e"), 0.12).alias("flat"))


# Partial copies

LEVEL = "loose"
_DESCRIBED = f"with recursive every as ({views.DUCK_TEXTS}), named as (select item_id, text, min(item_id) over (partition by text) as class_id from every), texts as (select item_id, text from named where item_id = class_id), described as materialized ({views.DUCK_DESCRIBED}), keys as materialized ({views.DUCK_KEYS}), candidates as materialized ({views.DUCK_CANDIDATES})"
_COPIED = "select class_id as a, item_id as b from named where item_id <> class_id"
_LENGTHS = f"select item_id, len({views._WORDS}) as length from texts"


def _classed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of the class representatives, their descriptors, and each other member with its representative."""
    every = views.texts(spark, sf_dir).withColumn("digest", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    classed = materialize(partial.copies(every, "digest"), "classes")
    texts = every.join(classed.where("item_id = class_id").select("item_id"), "item_id", "left_semi")
    return texts, materialize(windows.describe(texts), "described"), classed.where("item_id <> class_id").select(F.col("class_id").alias("a"), F.col("item_id").alias("b"))


@query(f"{_DESCRIBED} select a, b, votes, 'candidate' as relation from candidates union all select *, null, 'copy' from ({_COPIED})")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of different texts; beside them, of relation copy, each further equal text with its representative."""
    _, described, copies = _classed(spark, sf_dir)
    found = partial.candidates(described).withColumn("relation", F.lit("candidate"))
    return found.unionByName(copies.withColumn("relation", F.lit("copy")), allowMissingColumns=True)


@query(f"{_DESCRIBED}, sizes as ({_LENGTHS}), pairs as (select a, b from candidates), {views.duck_contained(LEVEL)} select *, 'contained' as relation from contained union all select a, b, null, 1.0, 1.0, 'copy' from ({_COPIED})")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold most of another, though words were changed, put in or left out; equal texts as in ``lsh_candidates``."""
    texts, described, copies = _classed(spark, sf_dir)
    sizes = materialize(windows.lengths(texts), "lengths")
    found = partial.containment_pairs(described, None, sizes, LEVEL, windows.WIDTH).withColumn("relation", F.lit("contained"))
    whole = copies.select("*", *[F.lit(1.0).alias(f"coverage_of_{x}") for x in "ab"], F.lit("copy").alias("relation"))
    return found.unionByName(whole, allowMissingColumns=True)


_REPORT = f"""with recursive every as (select doc_id as item_id, text from documents), named as (select item_id, text, min(item_id) over (partition by text) as class_id from every where text is not null),
texts as (select item_id, text from every where item_id not in (select item_id from named where item_id <> class_id)), described as materialized ({views.DUCK_DESCRIBED}), keys as materialized ({views.DUCK_KEYS}), candidates as materialized ({views.DUCK_CANDIDATES}),
vectors as (select vec_id, embedding[1:64] as e from embeddings), both_ways as (select vec_id, false as turned, e from vectors union all select vec_id, true, list_transform(range(64), lambda i: case when i < 1 + (vec_id // 10) % 8 then -e[i + 1] else e[i + 1] end) from vectors),
signed as materialized (select vec_id, turned, list_aggregate(list_transform(e, lambda x: case when x > m then '1' else '0' end), 'string_agg', '')::bit as phash, list_aggregate(list_transform(range(64), lambda i: case when e[(i + 1) % 64 + 1] > e[i + 1] then '1' else '0' end), 'string_agg', '')::bit as dhash
  from (select *, list_sort(e[2:64])[32] as m from both_ways)),
items as materialized (select file_id as item_id, path, size, mtime, len(list_filter(string_split_regex(coalesce(content, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as width, sha256(content) as digest, phash, dhash from ({views.DUCK_FILES}) f
  left join signed on vec_id = file_id - (file_id % 10 = 3)::int and turned = (file_id % 10 = 3)),
near as (select x.item_id as a, y.item_id as b from items x join items y on x.item_id < y.item_id and bit_count(xor(x.phash, y.phash)) <= 14 and bit_count(xor(x.dhash, y.dhash)) <= 20
  and greatest(x.width, y.width) / greatest(least(x.width, y.width), 1e-6) < 1.08),
links as (select class_id as a, item_id as b from named where item_id <> class_id union all select a, b from near),
both_ends as (select a, b from links union select b, a from links), walk(node, low) as (select a, a from both_ends union select b, low from walk join both_ends on node = a), labels as materialized (select node, min(low) as component from walk group by node),
ends as (select *, unnest([a, b]) as e from candidates), best as (select distinct a, b from (select * from ends qualify row_number() over (partition by e order by votes desc, a, b) <= 6)),
pairs as (select a, b from best left join labels x on x.node = a left join labels y on y.node = b where coalesce(x.component, a) <> coalesce(y.component, b)),
sizes as (select item_id, width as length from items), {views.duck_contained(LEVEL)},
more_links as (select a, b from links union all select a, b from contained), more_ends as (select a, b from more_links union select b, a from more_links),
more_walk(node, low) as (select a, a from more_ends union select b, low from more_walk join more_ends on node = a), grouped as materialized (select node as item_id, min(low) as group_id from more_walk group by node),
ranked as (select *, row_number() over w as rank, first_value(item_id) over w as k_id, first_value(digest) over w as k_digest, first_value(width) over w as k_width from items join grouped using (item_id) window w as (partition by group_id order by width desc, size desc, mtime, length(path), path)),
told as (select *, mine < 0.9 and theirs >= 0.85 as cropped, theirs < 0.9 and mine >= 0.85 as holds from (select r.*, coalesce(x.coverage_of_a, y.coverage_of_b) as mine, coalesce(x.coverage_of_b, y.coverage_of_a) as theirs
  from ranked r left join contained x on x.a = k_id and x.b = item_id left join contained y on y.b = k_id and y.a = item_id)),
members as (select group_id, item_id, path, size, rank, case when rank = 1 then 'keeper' when digest = k_digest then 'exact' when cropped then 'cropped' when holds then 'contains' when width > 0 and width < 0.9 * k_width then 'smaller' else 'similar' end as relation, mine, width / k_width as shrunk from told)"""


def _report(spark: SparkSession, sf_dir: str) -> report.Report:
    docs = views.document_items(spark, sf_dir)
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return report.find_duplicates(materialize(docs, "items"), windows.describe(texts), LEVEL, windows.WIDTH)


@query(f"{_REPORT} select group_id, item_id, path, rank, relation, case relation when 'cropped' then mine when 'smaller' then shrunk end as share from members")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the search over documents: exact copies, near signatures, capped candidates, containment, groups."""
    return _report(spark, sf_dir).members.select("group_id", "item_id", "path", "rank", "relation", "share")


@query(f"""{_REPORT} select group_id, case when bool_and(relation = 'exact') filter (rank > 1) then 'Exact copies' when bool_or(relation in ('cropped', 'contains')) filter (rank > 1) then 'Includes cropped versions' else 'Near-duplicates' end as title,
count(*) as members, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable, arg_min(path, rank) as keeper from members group by group_id""")
def duplicate_report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groups


# Ledger

_JOURNAL = f"with journal as materialized ({views.DUCK_JOURNAL})"
_RUNS = f"""{_JOURNAL}, runs as (select run_id, arg_min(type, seq) as first, max(operation) as operation, max(started) as started, count(*) filter (type = 'file') as transferred, coalesce(sum(size) filter (type = 'file'), 0)::bigint as bytes,
max(skipped) filter (type = 'end') as skipped, max(journal."at") filter (type = 'undo') as undone, count(*) filter (type = 'end') = 0 as interrupted from journal group by run_id)"""


@query(f"{_RUNS} select run_id, operation, strftime(started, '{DUCK_STAMP}') as started, transferred, bytes, skipped, strftime(undone, '{DUCK_STAMP}') as undone_at, interrupted from runs where first = 'run' order by runs.started desc, run_id limit 200")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = views.journal(spark, sf_dir)
    for c in ("failed", "cancelled"):
        j = j.withColumn(c, F.lit(None).cast("long"))
    top = ledger.history(j)
    return top.select("run_id", "operation", F.date_format("started", STAMP).alias("started"), "transferred", "bytes", "skipped", F.date_format("undone_at", STAMP).alias("undone_at"), "interrupted")


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies at sources and destinations now: a third of those, three quarters of these, of which some changed."""
    numbers = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("x"))
    moved = views.journal(spark, sf_dir).where("type = 'file'")
    sizes = moved.groupBy(F.substring_index("dst", "/", -1).cast("long").alias("x")).agg(F.min("size").alias("s"))
    return spark.sql(views.PRESENT, numbers=numbers.distinct(), sizes=sizes)


@query(f"""{_RUNS}, sizes as (select regexp_replace(dst, '^.*/', '')::bigint as x, min(size) as s from journal where type = 'file' group by 1), numbers as (select event_id as x from events),
present as ({views.PRESENT.replace('{numbers}', 'numbers').replace('{sizes}', 'sizes')}),
f as (select j.run_id, j.seq, j.src, j.dst, j.size, r.operation, a.path is not null as s, b.path is not null as d, b.size as now from journal j join runs r using (run_id) left join present a on a.path = j.src left join present b on b.path = j.dst where j.type = 'file' and r.first = 'run' and r.undone is null)
select run_id, seq, src, dst, case when operation = 'move' then case when d and not s then 'restored' when s and not d then 'already_back' when s and d then 'problem_original_spot' else 'problem_missing' end
                                   else case when not d then 'already_gone' when now <> size then 'problem_changed' else 'restored' end end as outcome from f""")
def undo_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = views.journal(spark, sf_dir)
    for c in ("failed", "cancelled"):
        j = j.withColumn(c, F.lit(None).cast("long"))
    return ledger.undo_outcomes(j, _present(spark, sf_dir))


@query(f"""{FILES}, up as (select file_id, unnest(list_transform(range(3, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) as folder from files)
select folder, len(string_split(folder, '/'))::int as depth from up group by folder having count(*) filter (file_id % 97 > 60 or file_id < 500) = count(*)""")
def emptied_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views.files(spark, sf_dir).select("file_id", "path")
    return ledger.emptied_folders(every, every.where("file_id % 97 > 60 or file_id < 500"), "/lib")


@query(f"""{_RUNS}, ends as (select j.run_id, j.seq, j.src, j.dst from journal j join runs r using (run_id) where j.type = 'file' and r.first = 'run' and r.undone is null) select run_id, seq, src, dst from ends order by run_id, seq desc limit 200""")
def undo_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What undoing takes back first, of the first runs by name."""
    j = views.journal(spark, sf_dir)
    for c in ("failed", "cancelled"):
        j = j.withColumn(c, F.lit(None).cast("long"))
    return ledger.undo_order(ledger.undo_outcomes(j, _present(spark, sf_dir))).select("run_id", "seq", "src", "dst").limit(200)


@query(f"{_RUNS} select run_id, operation, strftime(started, '{DUCK_STAMP}') as started, transferred, bytes, strftime(undone, '{DUCK_STAMP}') as undone_at, interrupted from runs where first = 'run' order by runs.started desc, run_id limit 200")
def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal appended to a ledger in two commits, read back, newest runs first."""
    path, j = scratch_path(spark, "journals"), views.journal(spark, sf_dir)
    for odd in (0, 1):
        ledger.append(j.where(F.col("run_id").cast("long") % 2 == odd), path)
    back = ledger.history(ledger.read_ledger(spark, path))
    return back.select(F.col("run_id").cast("string").alias("run_id"), "operation", F.date_format("started", STAMP).alias("started"), "transferred", "bytes", F.date_format("undone_at", STAMP).alias("undone_at"), "interrupted")


@query(f"{_JOURNAL} select run_id, count(*) as events, count(*) filter (type = 'file') as transferred, coalesce(sum(size) filter (type = 'file'), 0)::bigint as bytes from journal where run_id::bigint % 11 > 0 or seq < 5 group by run_id")
def journal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of other tools, a file to a run: with blank lines, and every eleventh cut short within its fifth line."""
    path, j = scratch_path(spark, "journal-files"), views.journal(spark, sf_dir)
    line = F.to_json(F.struct("type", "operation", "src", "dst", "size"))
    cut = (F.col("run_id").cast("long") % 11 == 0) & (F.col("seq") == 5)
    lines = j.select("run_id", "seq", F.when(cut, F.substring(line, 1, 9)).when(F.col("seq") % 6 == 0, F.concat(F.lit("\n"), line)).otherwise(line).alias("value"))
    journals.write(lines, path)
    is_file, named = F.col("type") == "file", F.substring_index(F.substring_index("run_id", "/", -1), ".", 1)
    back = ledger.read_journals(spark, path)
    return back.groupBy(named.alias("run_id")).agg(F.count(F.lit(1)).alias("events"), F.count_if(is_file).alias("transferred"), F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"))


# Review

_MARKED = f"{_COPIES}, marks as (select path, size, digest from m where rank > 1), toggled as (select path, digest from m where size % 2 = 0)"
_AFTER = f"{_MARKED}, now as (select path from m where (rank > 1) <> (size % 2 = 0))"


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members of exact groups, and marks: those suggested, then those of even size switched."""
    found = materialize(exact.exact_members(views.files(spark, sf_dir)).withColumnRenamed("digest", "group_id"), "members")
    return found, review.toggle(review.suggested(found), found.where("size % 2 = 0").select("path"))


@query(f"{_AFTER} select path from now")
def marks_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)[1]


_CHOICES = f"{_MARKED}, one as (select digest from m where rank = 2 order by path limit 1), two as (select digest from m where rank = 2 order by path desc limit 1), kept as (select path from m where rank = 2 and digest in (from one))"


@query(f"{_CHOICES} select path from m where case when digest in (from one) then path not in (from kept) when digest in (from two) then false else rank > 1 end")
def keep_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested marks after one group keeps its second file only and another keeps all."""
    found = materialize(exact.exact_members(views.files(spark, sf_dir)).withColumnRenamed("digest", "group_id"), "members")
    ends = found.where("rank = 2").agg(F.min("path"), F.max("path")).first()
    return review.keep_group(found, review.keep_only(found, review.suggested(found), ends[0]), ends[1])


@query(f"{_COPIES}, now as (select path from m where rank > 1 or n % 2 = 1) select digest as group_id, count(*) as members from m group by digest having bool_and(path in (select path from now))")
def fully_marked_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of which nothing would be left, when the keepers of odd-sized groups are marked too."""
    from pyspark.sql import Window

    found = materialize(exact.exact_members(views.files(spark, sf_dir)).withColumnRenamed("digest", "group_id"), "members")
    odd = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group_id"))).where("rank = 1 and n % 2 = 1").select("path")
    return review.fully_marked(found, review.suggested(found).union(odd))


@query(f"{_AFTER} select digest as group_id, count(*) as members from m group by digest having bool_and(path in (select path from now))")
def fully_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fully_marked(*_review(spark, sf_dir))


@query(f"{_AFTER} select count(*) as files, coalesce(sum(size), 0)::bigint as bytes from m where path in (select path from now)")
def marked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.marked_totals(*_review(spark, sf_dir))


@query(f"{_AFTER}, rest as (select *, count(*) over (partition by digest) as c from m where path not in (select path from now)) select path, digest as group_id from rest where c > 1")
def after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.after_removal(*_review(spark, sf_dir)).select("path", "group_id")


@query(f"{_AFTER} select path, size, 'photos' as category, '/lib/src1' as dest_folder, regexp_replace(path, '^.*/', '') as dest_name, 'check_first' as status, true as included from m where path in (select path from now) and not starts_with(path, '/lib/src1/')")
def quarantine_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.quarantine(*_review(spark, sf_dir), "/lib/src1")


@query(f"""{FILES}, x as (select string_split(path, '/')[3] as source, string_split(regexp_replace(path, '/[^/]*$', ''), '/') as p from files), n as (select source, min(len(p)) as most from x group by source),
same as (select source, i, count(distinct p[i]) as c from x join n using (source), range(1, 30) t(i) where i <= most group by all), cut as (select source, coalesce(min(i) filter (c > 1), max(i) + 1) - 1 as k from same group by source)
select source, array_to_string(any_value(p)[1:any_value(k)], '/') as folder from x join cut using (source) group by source""")
def common_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder that all files of a source have in common, for every source."""
    return review.common_parent(views.files(spark, sf_dir).select("path", F.split("path", "/")[2].alias("source")), "source")


# Feature store

_STORE = f"{FILES}, store as (select path, size, mtime, case when file_id % 5 = 0 then 1 else 2 end as version from files where file_id % 3 <> 0 and file_id % 7 <> 0 union all select path, size + 1, mtime, 2 from files where file_id % 3 <> 0 and file_id % 7 = 0)"


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = views.files(spark, sf_dir).select("file_id", "path", "size", "mtime")
    old = every.where("file_id % 3 <> 0").select("path", F.expr("case when file_id % 7 = 0 then size + 1 else size end").alias("size"), "mtime", F.expr("case when file_id % 7 <> 0 and file_id % 5 = 0 then 1 else 2 end").alias("version"))
    return every, old


@query(f"{_STORE} select path from files f where not exists (select 1 from store s where s.path = f.path and s.size = f.size and s.mtime = f.mtime and version = 2)")
def feature_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_do(*_store(spark, sf_dir), 2).select("path")


@query(f"""{FILES}, store as (select *, file_id % 2 = 0 as flat, case when file_id % 3 = 0 then 'broken' end as error, case when file_id % 5 = 0 then 0 when file_id % 7 > 0 then 9 end as n_descriptors from files where file_id % 11 > 0)
select path from files where path not in (select path from store where flat or error is not null or coalesce(n_descriptors, 0) > 0)""")
def feature_todo_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a row, and those whose row has no descriptors though it is neither flat nor broken."""
    every = views.files(spark, sf_dir).select("file_id", "path", "size", "mtime")
    kept = every.where("file_id % 11 > 0").select("path", "size", "mtime", F.lit(2).alias("version"), F.expr("file_id % 2 = 0").alias("flat"), F.expr("case when file_id % 3 = 0 then 'broken' end").alias("error"), F.expr("case when file_id % 5 = 0 then 0 when file_id % 7 > 0 then 9 end").alias("n_descriptors"))
    return store.to_do(every, kept, 2, with_descriptors=True).select("path")


@query(f"{_STORE}, fresh as (select path, size, 2 as version from files f where not exists (select 1 from store s where s.path = f.path and s.size = f.size and s.mtime = f.mtime and version = 2)) select path, size, version from fresh union all select path, size, version from store where path not in (select path from fresh)")
def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, old = _store(spark, sf_dir)
    new = store.to_do(every, old, 2).select("path", "size", "mtime", F.lit(2).alias("version"))
    return store.upsert(old, new).select("path", "size", "version")


# Streams, over what Spark writes in several files


_STATES = f"""{_JOURNAL}, told as (select run_id, count(*) filter (type = 'file') as transferred, coalesce(sum(size) filter (type = 'file'), 0)::bigint as bytes, max(seq) as last_seq,
  arg_min(type, seq) as first, min(seq) filter (type = 'end') as ended, max(seq) filter (type in ('file', 'mkdir', 'rmdir')) as work, count(*) filter (type = 'undo') as undos from journal group by run_id),
judged as (select *, case when first <> 'run' then 'no header' when work > ended then 'event after end' when undos > 1 then 'undone twice' end as problem from told)
select run_id, transferred, bytes, case when problem is not null then 'invalid' when undos > 0 then 'undone' when ended is not null then 'finished' else 'open' end as state, problem, last_seq from judged"""


@query(_STATES)
def stream_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of runs from events that arrive in no order, in two calls of one stream: late events, second undos, runs cut off."""
    path, kept = scratch_path(spark, "ledger"), scratch_path(spark, "run-states")
    j = views.journal(spark, sf_dir)
    for odd in (1, 0):
        j.where(F.col("seq") % 2 == odd).repartition(6).write.mode("append").json(path)
        states = runs.keep_status(runs.watch_ledger(spark, path), kept)
    return states.read().drop("commit")


@query(_STATES)
def batch_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(views.journal(spark, sf_dir))


@query(f"""{FILES}, signed as (select path, mtime, sha256(content) as digest, case when file_id % 2 = 0 then 0 else 1 end as call from files),
ordered as (select *, first_value(path) over w as first, first_value(call) over w as first_call from signed window w as (partition by digest order by call, mtime, path))
select path, digest, case when path <> first and digest is not null then first end as copy_of from ordered""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of even number arrive first, then the others: which are copies of what came before."""
    path, kept = scratch_path(spark, "arrivals"), scratch_path(spark, "first-seen")
    signed = views.files(spark, sf_dir).select("file_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.col("mtime").alias("seen"))
    for odd in (0, 1):
        signed.where(F.col("file_id") % 2 == odd).drop("file_id").write.mode("append").parquet(path)
        runs.mark_copies(spark.readStream.schema("path string, digest string, seen timestamp").parquet(path), kept, keep=None)
    return runs.marked(spark, kept).drop("seen")


@query(f"{FILES} select path, case when file_id % 3 = 0 then size + 1 else size end as size, 2 as version from files where file_id % 3 = 0 or file_id % 2 = 0")
def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that takes in a listing, and then, going on with the same stream, one in which some files have changed."""
    listed, kept = scratch_path(spark, "listings"), scratch_path(spark, "store")
    every = views.files(spark, sf_dir).select("file_id", "path", "size", "mtime")
    for part in (every.where("file_id % 2 = 0"), every.where("file_id % 3 = 0").withColumn("size", F.col("size") + 1)):
        part.drop("file_id").write.mode("append").parquet(listed)
        runs.refresh_store(spark.readStream.schema("path string, size long, mtime timestamp").parquet(listed), kept, 2, lambda todo: todo)
    return store.KeptStore(spark, kept).read().select("path", "size", "version")


# Labels

_SIZES = "case when s = 1 then '1 byte' when s < 1000 then s || ' bytes' " + " ".join(f"when s < {1000 ** (p + 1)} then case when s / {1000.0 ** p} < 100 then format('{{:.1f}} {u}', s / {1000.0 ** p}) else format('{{:.0f}} {u}', s / {1000.0 ** p}) end" for p, u in ((1, "KB"), (2, "MB"), (3, "GB"))) + " end"


@query(f"{FILES} select file_id, {_SIZES} as label from (select file_id, size * (1 + file_id % 700) as s from files)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("file_id", paths.human_size(F.col("size") * (1 + F.col("file_id") % 700)).alias("label"))


@query(f"{FILES} select file_id, case when starts_with(path, '/lib/src1/') then '~' || path[10:] else path end as label from files")
def short_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("file_id", paths.short_path(F.col("path"), "/lib/src1").alias("label"))


@query(f"{_CROPS} select a, b, round_even(of_a * 100, 0)::int || '%' as label from crops")
def percent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of one item of a link shows in the other."""
    return _crops(_links(spark, sf_dir)).select("a", "b", paths.percent(F.col("coverage_of_a")).alias("label"))
