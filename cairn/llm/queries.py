"""The thirteen operators as queries over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe_codec import round_trip_digests
from cairn.llm.decontaminate import contamination
from cairn.llm.hard_negatives import hard_negatives
from cairn.llm.licenses import license_matches, templates
from cairn.llm.near_dedup import near_duplicates
from cairn.llm.ngram_model import train_and_score
from cairn.llm.quality import quality_rules
from cairn.llm.sharding import assign_shards
from cairn.llm.sharding import oracle as shards_oracle
from cairn.llm.token_counts import token_counts
from cairn.llm.toxicity import toxicity
from cairn.llm.url_filter import verdicts
from cairn.llm.vector_codes import code_report
from cairn.llm.warc import archive_and_read

#: A shard's limit: what a loader takes at a time.
SHARD_BYTES = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_table(spark, sf_dir, "documents"), templates(spark))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, stored=True)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select(placed.key.alias("doc_id"), "bytes", "depth", "shard")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages"), least_bytes=0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(_table(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", turned))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_licenses": op4_licenses,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_scores": op7_ngram_scores,
    "op8_quality": op8_quality,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_url_filters": op12_url_filters,
    "op13_hard_negatives": op13_hard_negatives,
}

_NEAR = """
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
each as (select doc_id, unnest(s) as g from sets),
met as (select a.doc_id as a, b.doc_id as b, count(*) as common from each a join each b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from met join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * common >= 75 * (len(x.s) + len(y.s) - common)),
ends as materialized (select a, b from links union select b, a from links),
walk(node, low) as (select a, a from ends union select b, low from walk join ends on node = a),
labels as (select node, min(low) as component from walk group by node)
select doc_id, len(s)::bigint as n_shingles, coalesce(component, doc_id) as component_id, coalesce(component, doc_id) = doc_id as kept from sets left join labels on node = doc_id"""

_ARCHIVED = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as x, min(page_id) over (partition by html) as low from p)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (n // 8 * 10 + 1)::int, 10))::bigint >> (35 - 5 * (n % 8))::int) & 31) + 1)::int, 1)), '') as payload_digest,
       case when low = page_id then 'response' else 'revisit' end as record_type, case when low <> page_id then low end as refers_to from d"""


def _vector_codes(rounds: int = 6) -> str:
    """Rounds are written out one after the other, each by comparing every part with every entry."""
    by_distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    sql = """
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] as x from kept, range(8) t(p)),
start as (select vec_id, row_number() over (order by vec_id) - 1 as k from kept order by vec_id limit 16),
books0 as materialized (select p, k, x as c from parts join start using (vec_id))"""
    for n in range(rounds + 1):
        sql += f""",
near{n} as materialized (select vec_id, label, p, x, min({by_distance} * 16 + k) as m from parts join books{n} using (p) group by all)"""
        if n < rounds:
            sql += f""",
means{n} as (select p, k, list(mean order by i) as c from (
   select p, m % 16 as k, i, floor(sum(x[i]) / count(*))::bigint as mean from near{n}, lateral (select unnest(range(1, len(x) + 1)) as i) group by all) group by all),
books{n + 1} as materialized (select b.p, b.k, coalesce(n.c, b.c) as c from books{n} b left join means{n} n on n.p = b.p and n.k = b.k)"""
    return sql + f""",
coded as (select vec_id, label, string_agg(format('{{:02x}}', (m % 16)::bigint), '' order by p) as code, sum(m // 16)::bigint as error from near{rounds} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) from books{rounds}) as codebooks_sha256 from coded"""


_VERDICTS = """
with u as (select page_id, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1, 's') else '' end as hp from pages),
s as (select page_id, translate(regexp_extract(hp, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(hp, length(regexp_extract(hp, '^([^/]*)', 1, 's')) + 1) as path from u),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select s.page_id, host, path, rule, case when rule is not null then v
   when contains(host, 'spam') or ends_with(host || path, '.exe') or contains(path, '/wp-admin/') then 'block' else 'allow' end as verdict from s left join fit using (page_id)"""

_NEGATIVES = """
with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
              where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as materialized (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
best as (select * from scores where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
met as (select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
               row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank
        from best p join scores n using (anchor_id) where not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from met where rank <= 3"""

ORACLES: dict[str, str] = {
    "op2_near_dedup": _NEAR,
    "op10_warc": _ARCHIVED,
    "op3_sharding": shards_oracle(SHARD_BYTES),
    "op11_vector_codes": _vector_codes(),
    "op12_url_filters": _VERDICTS,
    "op13_hard_negatives": _NEGATIVES,
}
