"""Registered queries over the given tables, one per operator, and the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from scorelake.llm import (
    bpe, clustering, decontam, fertility, licenses, pii, quality, resample, simhash, substrings, tokenfiles, toxicity, warc,
)
from scorelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.PATTERN)


@query("op4_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_decontamination", """
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
wins as (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') s
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) k from b where len(w) > 0)),
sizes as (select distinct n from wins),
places as (
  select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') s
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) k from d cross join sizes)),
found as (select doc_id, p.n, k, item_id from places p join wins using (n, s)),
hit as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(k, k + n)) j from found) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) l
          from (select distinct doc_id, cast(item_id as varchar) i from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join named using (doc_id)
""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op2_warc_archive", """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end refers_to
from f
""")
def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


@query("op7_tokeniser_fertility")
def tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "chars_per_token", "fallback_share", "entropy")


@query("op8_toxicity")
def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_rule_quality")
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def clustering_sql(k: int = clustering.CENTROIDS, rounds: int = clustering.ROUNDS) -> str:
    """Lloyd rounds unrolled: every round assigns all vectors and takes exact floors of the means."""
    parts = ["""
v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) w from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""", f"""
c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id)) - 1 cluster, w from v
  qualify row_number() over (order by sha256('2:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} as materialized (
  select vec_id, any_value(w) w, min(struct_pack(distance := d, cluster := cluster)) best
  from (select vec_id, v.w, cluster, list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d
        from v cross join c{r} c) group by vec_id)""")
        if r < rounds:
            parts.append(f"""
m{r} as (select cluster, place, sum(x)::bigint s, count(*) n
        from (select best.cluster cluster, unnest(w) x, unnest(range(1, 65)) place from a{r}) group by all),
c{r + 1} as materialized (
  select cluster, coalesce(moved, c.w) w from c{r} c
  left join (select cluster, list((s - ((s % n) + n) % n) // n order by place) moved from m{r} group by cluster) using (cluster))""")
    return "with" + ",".join(parts) + f"""
select vec_id, cast(best.cluster as integer) as cluster, cast(best.distance as bigint) distance,
       cast(sum(best.distance) over (partition by best.cluster) as bigint) cluster_inertia,
       cast(sum(best.distance) over () as bigint) inertia, sha256(array_to_string(c.w, ',')) centroid_sha256
from a{rounds} join c{rounds} c on c.cluster = best.cluster
"""


@query("op11_laesa_clusters", clustering_sql())
def laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


@query("op12_substring_dedup", r"""
with d as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
k as materialized (
  select doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) s
  from (select doc_id, w, unnest(range(1, len(w) - 48)) p from d where len(w) >= 50)),
f as (select s, min(doc_id) least from k group by s),
gone as (select distinct doc_id, unnest(range(p, p + 50)) j from k join f using (s) where doc_id > least),
kept as (
  select d.doc_id, string_agg(x, ' ' order by d.j) t, count(*) n
  from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) j from d) d
  left join gone on gone.doc_id = d.doc_id and gone.j = d.j where gone.j is null group by d.doc_id)
select doc_id, len(w)::bigint n_words, len(w)::bigint - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id)
""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


@query("op13_importance_resampling", r"""
with tbl as (
  select list(list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)
              order by i) crc from range(256) t(i)),
d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
dw as materialized (select doc_id, x, count(*) n from (select doc_id, unnest(w) x from d) group by all),
bw as materialized (select x, count(*) n from (select unnest(w) x from b) group by all),
coded as materialized (
  select x, xor(4294967295, list_reduce(list_concat([4294967295::bigint], bytes),
                                        lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1]))) % 10000 bucket
  from (select x, list_transform(range(octet_length(encode(x))), lambda i:
                    ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::bigint) bytes
        from (select x from dw union select x from bw)) cross join tbl),
s as (select bucket, sum(n) s from dw join coded using (x) group by bucket),
t as (select bucket, sum(n) t from bw join coded using (x) group by bucket),
gain as materialized (
  select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(n), 0) from dw) + 10000)::double
      / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(n), 0) from bw) + 10000)::double))) as bigint) g
  from s full join t using (bucket)),
weights as (select doc_id, sum(n * g)::bigint total from dw join coded using (x) join gain using (bucket) group by doc_id),
scored as (
  select doc_id, len(w)::bigint n_features,
         case when len(w) = 0 then 0 else (total - ((total % len(w)) + len(w)) % len(w)) // len(w) end::bigint weight,
         cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296))) as bigint) noise
  from d left join weights using (doc_id)),
placed as (
  select *, weight + noise score, row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id) place,
         count(*) filter (n_features >= 20) over () n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end rank from placed
""")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
