"""Inventories, signatures and journals as views over the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import bits, windows
from cairn.operators import partial
from cairn.sources.inventory import CATEGORIES

FILES = """
select doc_id as file_id,
  concat('/lib/', source, '/', cast(cast(floor(doc_id / 97.0) as bigint) as varchar(20)),
         '/doc_', cast(doc_id % 97 as varchar(20)), '.',
         split_part('jpg,JPG,png,mov,mp4,txt,md,pdf,csv,zip,json,xyz', ',', cast(doc_id % 12 + 1 as int))) as path,
  n_chars as size,
  TIMESTAMP '2021-01-01 00:00:00' + INTERVAL '7' HOUR * doc_id as mtime,
  case when doc_id % 3 = 0 then null
       else TIMESTAMP '2021-01-01 00:00:00' + INTERVAL '7' HOUR * (doc_id - 30) end as birthtime,
  text as content
from {documents}"""

LISTING = """
select case file_id % 10 when 0 then concat('/lib/.git/o', cast(file_id as varchar(20)))
                         when 1 then concat('/lib/a/.h', cast(file_id as varchar(20)))
                         when 2 then concat('/lib/Trip.PhotosLibrary/originals/p', cast(file_id as varchar(20)))
                         when 3 then concat('/lib/sorted/s', cast(file_id as varchar(20)))
                         else path end as path,
       case when file_id % 10 = 4 then 'symlink' else 'file' end as kind, size, mtime, birthtime
from {files}"""

TAGS = """
select file_id, path, mtime, birthtime,
       case when file_id % 11 = 0 then '0000:00:00 00:00:00' when file_id % 3 <> 1 then {stamp} end as original,
       case when file_id % 2 = 0 then concat({stamp}, '+02') end as digitized, cast(null as varchar(30)) as datetime,
       case when file_id % 5 = 0 then cast(0 as bigint) else cast(3682844800 as bigint) + file_id * 3600 end as seconds
from {files}"""

JOURNAL = """
with e as (select user_id, event_id, ts, event_type, value, row_number() over (partition by user_id order by ts, event_id) as seq,
                  count(*) over (partition by user_id) as n from {events}),
     own as (select cast(user_id as varchar(20)) as run_id, cast(seq as bigint) as seq,
               case when seq = 1 then 'run' when seq = n and user_id % 5 <> 0 then 'end'
                    when event_type in ('click', 'view', 'purchase') then 'file' when event_type = 'signup' then 'mkdir' else 'rmdir' end as type,
               case when seq = 1 then case when user_id % 2 = 0 then 'copy' else 'move' end end as operation,
               case when seq = 1 then ts end as started,
               concat('/lib/', cast(event_id % 500 as varchar(20))) as src,
               concat('/sorted/', cast(event_id % 700 as varchar(20))) as dst,
               cast(floor(value * 100) as bigint) as size,
               case when seq = n and user_id % 5 <> 0 then ts end as finished,
               case when seq = n and user_id % 5 <> 0 then cast(user_id % 3 as bigint) end as skipped,
               cast(null as {stamp}) as at
             from e)
select * from own
union all
select run_id, max(seq) + 1, 'undo', null, null, null, null, null, null, null, max(started) + INTERVAL '1' DAY
from own where cast(run_id as bigint) % 7 = 0 group by run_id
union all
select run_id, max(seq) + 2, 'undo', null, null, null, null, null, null, null, max(started) + INTERVAL '2' DAY
from own where cast(run_id as bigint) % 21 = 0 group by run_id
union all
select run_id, max(seq) + 3, 'file', null, null, concat('/lib/', cast(900000 + cast(run_id as bigint) as varchar(20))), concat('/sorted/', cast(900000 + cast(run_id as bigint) as varchar(20))), cast(7 as bigint), null, null, null
from own where cast(run_id as bigint) % 16 = 1 group by run_id"""

PRESENT = """
select concat('/lib/', cast(x as varchar(20))) as path, cast(x as bigint) as size from {numbers} where x < 500 and x % 3 = 0
union all
select concat('/sorted/', cast(x as varchar(20))), case when x % 5 = 0 then s else s + 1 end from {sizes} where x % 4 <> 0"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; content is read only where it is asked for."""
    return spark.sql(FILES, documents=table(spark, sf_dir, "documents"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTING, files=files(spark, sf_dir))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TAGS.replace("{stamp}", "date_format(mtime, 'yyyy:MM:dd HH:mm:ss')"), files=files(spark, sf_dir))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOURNAL.replace("{stamp}", "timestamp"), events=table(spark, sf_dir, "events"))


def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.substring_index(url, "/", -1), F.lit(".Html")).alias("name"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64 low frequencies, every tenth again with some signs changed."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("e"))
    turned = F.transform("e", lambda x, i: F.when(i < 1 + F.floor(F.col("vec_id") / 10) % 16, -x).otherwise(x))
    more = e.where("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000).alias("item_id"), turned.alias("e"), "vec_id")
    every = e.select(F.col("vec_id").alias("item_id"), "e", "vec_id").unionByName(more)
    return every.select("item_id", bits.frequency_signature(F.col("e")).alias("phash"), bits.gradient_signature(F.col("e")).alias("dhash"), (400 + 100 * (F.col("vec_id") % 5)).alias("width"), F.lit(300).cast("long").alias("height"), (F.col("item_id") % 7).alias("size"), F.lit(False).alias("flat"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures with the columns that groups are made from."""
    return signatures(spark, sf_dir).select("*", F.concat(F.lit("/img/"), F.col("item_id").cast("string")).alias("path"), F.timestamp_seconds(F.col("item_id")).alias("mtime"), F.when(F.col("item_id") % 50 == 0, F.lit("same")).otherwise(F.col("item_id").cast("string")).alias("digest"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and benchmark items (from 10**9 on), with their words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    bench = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("item_id"), "text")
    return docs.unionByName(bench)


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items, as wide as they have words; the vector of a document's own number makes its signatures, and one without is flat.

    Every tenth, of those that end in 3, has the signs of the first few values of its neighbour's vector changed.
    """
    e = signatures_of(table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("e")))
    own = files(spark, sf_dir).select(F.col("file_id").alias("item_id"), "path", "size", "mtime", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.size(windows.words(F.col("content"))).cast("long").alias("width"))
    turned = (F.col("item_id") % 10 == 3).alias("turned")
    met = own.select("*", turned, (F.col("item_id") - turned.cast("long")).alias("vec_id")).join(e, ["vec_id", "turned"], "left")
    return met.select("item_id", "path", "size", "mtime", "digest", "phash", "dhash", "width", F.lit(1).cast("long").alias("height"), F.col("phash").isNull().alias("flat"))


def signatures_of(vectors: DataFrame) -> DataFrame:
    """Both signatures of each vector (vec_id, e), as it is and with some signs changed (``turned``)."""
    turned = F.transform("e", lambda x, i: F.when(i < 1 + F.floor(F.col("vec_id") / 10) % 8, -x).otherwise(x))
    every = vectors.select("vec_id", "e", F.lit(False).alias("turned")).unionByName(vectors.select("vec_id", turned.alias("e"), F.lit(True).alias("turned")))
    return every.select("vec_id", "turned", bits.frequency_signature(F.col("e")).alias("phash"), bits.gradient_signature(F.col("e")).alias("dhash"))


# DuckDB's form of what is made of columns above.

DUCK_FILES = FILES.replace("{documents}", "documents")
DUCK_LISTING = LISTING.replace("{files}", "files")
DUCK_TAGS = TAGS.replace("{stamp}", "strftime(mtime, '%Y:%m:%d %H:%M:%S')").replace("{files}", "files")
DUCK_JOURNAL = JOURNAL.replace("{stamp}", "timestamp").replace("{events}", "events")
DUCK_EXTENSIONS = "select * from (values " + ", ".join(f"('.{e}', '{k}', '{label}')" for k, (label, names) in CATEGORIES.items() for e in names.split()) + ") x(ext, category, label)"
DUCK_NAMED = """
select f.*, regexp_replace(path, '^.*/', '') as name, coalesce(x.category, 'other') as category, coalesce(x.label, 'Other') as label
from files f left join exts x on x.ext = lower(regexp_extract(regexp_replace(path, '^.*/', ''), '^.+(\\.[^.]+)$', 1))"""
DUCK_SIGNATURES = """
select item_id, vec_id, m, e, list_aggregate(list_transform(e, lambda x: case when x > m then '1' else '0' end), 'string_agg', '')::bit as phash,
       list_aggregate(list_transform(range(64), lambda i: case when e[(i + 1) % 64 + 1] > e[i + 1] then '1' else '0' end), 'string_agg', '')::bit as dhash,
       400 + 100 * (vec_id % 5) as width, 300 as height, item_id % 7 as size, '/img/' || item_id as path,
       case when item_id % 50 = 0 then 'same' else item_id::varchar end as digest
from (select item_id, vec_id, e, list_sort(e[2:64])[32] as m from (
  select vec_id as item_id, vec_id, embedding[1:64] as e from embeddings
  union all
  select vec_id + 1000000, vec_id, list_transform(range(64), lambda i: case when i < 1 + (vec_id // 10) % 16 then -embedding[i + 1] else embedding[i + 1] end)
  from embeddings where vec_id % 10 = 0))"""


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LEAST = ", ".join(f"min(h[{k + 1}]) over reach as m{k}" for k in range(windows.PARTS))
_BYTES = ", ".join(f"m{k} & 255" for k in range(windows.PARTS))
DUCK_TEXTS = "select doc_id as item_id, text from documents union all select item_id + 1000000000, text from benchmark"
#: (item_id, pos, c): descriptors of the table ``texts`` as lists of 32 bytes.
DUCK_DESCRIBED = f"""
select s.item_id, s.pos, s.c from (
  select item_id, pos, [{_BYTES}] as c, m from (
    select item_id, pos, greatest(1, n - {windows.WIDTH - 1}) as m, {_LEAST} from (
      select item_id, pos, h, count(*) over (partition by item_id) as n from (
        select item_id, unnest(w) as w, unnest(range(len(w))) as pos from (select item_id, {_WORDS} as w from texts))
      join (select w, list_transform(range({windows.PARTS}), lambda k: ('0x' || substr(sha256((k // 8)::varchar || ' ' || w), (k % 8 * 8 + 1)::int, 8))::bigint) as h
            from (select distinct unnest({_WORDS}) as w from texts)) using (w))
    window reach as (partition by item_id order by pos rows between current row and {windows.WIDTH - 1} following)) where pos < m) s
join (select distinct item_id, (v % 4294967296)::bigint as pos from (
    select item_id, pos, m, min(h1::hugeint * 4294967296 + pos) over (partition by item_id order by pos rows between current row and {windows.SPAN - 1} following) as v from (
      select item_id, pos, h1, greatest(1, count(*) over (partition by item_id) - {windows.WIDTH - 1}) as m from (
        select item_id, pos, ('0x' || substr(sha256('0 ' || w), 1, 8))::bigint as h1 from (select item_id, unnest(w) as w, unnest(range(len(w))) as pos from (select item_id, {_WORDS} as w from texts))))
    where pos < m) where pos <= greatest(0, m - {windows.SPAN})) t on t.item_id = s.item_id and t.pos = s.pos"""
_SAMPLES = "[" + ", ".join("[" + ", ".join(str(p + 1) for p in t) + "]" for t in partial.samples()) + "]"
#: (a, b, votes) from ``described`` (item_id, pos, c).
DUCK_CANDIDATES = f"""
select k1.item_id as a, k2.item_id as b, count(*) as votes from keys k1 join keys k2 on k1.key = k2.key and k1.item_id < k2.item_id group by all having count(*) >= {partial.VOTES}"""
DUCK_KEYS = f"""
select distinct item_id, unnest(list_transform(range({partial.TABLES}), lambda t: array_to_string(list_concat([t], list_transform(list_slice(({_SAMPLES})[t + 1], 1, n), lambda p: c[p])), ' '))) as key
from described, (select case when count(*) > 1 then ceil((log2(count(*)) + 1) / 8)::int else 1 end as n from described)"""
_WORDS32 = ", ".join(f"(c[{4 * k + 1}] * 16777216 + c[{4 * k + 2}] * 65536 + c[{4 * k + 3}] * 256 + c[{4 * k + 4}])::bigint as e{k}" for k in range(8))
_FAR = " + ".join(f"bit_count(xor(x.e{k}, y.e{k}))::int" for k in range(8))
#: (a, b, inliers, coverage_of_a, coverage_of_b) from ``described``, ``pairs`` (a, b) and ``sizes`` (item_id, length). Every two descriptors with an equal sub-block are compared.
DUCK_CONTAINED = """
turned as (select case when y.length > x.length then a else b end as small, case when y.length > x.length then b else a end as large, least(x.length, y.length) as n_small, greatest(x.length, y.length) as n_large
           from pairs join sizes x on x.item_id = a join sizes y on y.item_id = b),
placed as (select * from turned where n_small >= {least} and n_small >= 0.15 * n_large),
worded as materialized (select item_id, pos, c, {words32}, list_transform(range(16), lambda k: k * 65536 + c[2 * k + 1] * 256 + c[2 * k + 2]) as subs from described),
distinct_ as materialized (select item_id, subs, min(pos) as j, count(*) as times, {any32} from worded group by item_id, c, subs),
mine as (select item_id, pos, unnest(subs) as sub from worded), theirs as (select item_id, j, unnest(subs) as sub from distinct_),
met as materialized (select distinct small, large, m.pos as i, t.j from placed join mine m on m.item_id = small join theirs t on t.item_id = large and t.sub = m.sub),
far as (select small, large, i, met.j, y.times, {far} as d from met join worded x on x.item_id = small and x.pos = i join distinct_ y on y.item_id = large and y.j = met.j),
ordered as (select *, row_number() over (partition by small, large, i order by d, j) as r, lead(d) over (partition by small, large, i order by d, j) as second from far),
matches as (select small, large, i, j from ordered where r = 1 and times = 1 and d < 64 and (second is null or d < 0.8 * second)),
stepped as (select *, j - i as o, coalesce((j - i - lag(j - i) over (partition by small, large order by j - i, i) > {drift})::int, 0) as new from matches),
linked as (select *, sum(new) over (partition by small, large order by o, i rows unbounded preceding) as chain from stepped),
chains as (select small, large, chain, count(*) as n, min(o) as least, min(i) as i0, max(i) as i1, arg_min(o, i) as o0, arg_max(o, i) as o1 from linked group by all),
largest as (select *, sum(n) over (partition by small, large) as total from chains qualify row_number() over (partition by small, large order by n desc, least) = 1),
covered as (select small, large, n as inliers, greatest(0, least(n_small, n_large - o1) - greatest(0, -o0)) / n_small as of_small, greatest(0, least(n_large, n_small + o1) - greatest(0, o0)) / n_large as of_large
            from largest join placed using (small, large) where n >= {least} and n >= 0.3 * total and i1 - i0 + {width} >= 0.2 * n_small),
contained as (select least(small, large) as a, greatest(small, large) as b, inliers, case when small < large then of_small else of_large end as coverage_of_a, case when small < large then of_large else of_small end as coverage_of_b
              from covered where least(of_small, of_large) >= 0.15 and greatest(of_small, of_large) >= 0.85)"""


def duck_contained(level: str) -> str:
    any32 = ", ".join(f"any_value(e{k}) as e{k}" for k in range(8))
    return DUCK_CONTAINED.replace("{words32}", _WORDS32).replace("{any32}", any32).replace("{far}", _FAR).replace("{least}", str(partial.INLIERS[level])).replace("{drift}", str(partial.DRIFT)).replace("{width}", str(windows.WIDTH))
