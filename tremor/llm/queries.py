"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import fresh_path
from . import (decontaminate, exact_dedup, html_text, jaccard, language, licenses, packing, pii, quality_rank, repeats, token_file,
               vector_codes, whitening)
from .common import table, tokenizer_path
from .tokens import AMPLE


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = token_file.write(table(spark, sf_dir, "documents"), fresh_path(spark, "token-file"), tokenizer_path("word_bpe_49k.json"), 1)
    return token_file.digests(spark, token_file.open_file(spark, file.path))


def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0, memory=AMPLE)


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def coded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": personal_data,
    "op2_token_file": token_ids,
    "op3_best_fit_packing": best_fit,
    "op4_exact_dedup": exact_groups,
    "op5_language_id": languages,
    "op6_html_text": main_texts,
    "op7_jaccard_join": near_components,
    "op8_license_scan": license_scan,
    "op9_quality_rank": quality,
    "op10_decontamination": contamination,
    "op11_vector_codes": coded_vectors,
    "op12_suffix_dedup": repeated_strings,
    "op13_whitening": whitened,
    "pipeline": corpus_pipeline.run,
}

EXACT_SQL = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id,
       min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from n
"""

CONTAMINATION_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), iw as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), lengths as (select distinct k from iw), dw as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lengths where len(w) >= k)
), m as (select doc_id, item_id, i, k from dw join iw using (k, g)
), hits as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names
  from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join named using (doc_id)
"""

_NEAREST = """
a{k} as (
  select row, p, x, arg_min(e, (d, e)) as e, min(d) as d
  from (select row, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts join b{k} using (p))
  group by row, p, x
)"""
_MEANS = """
m{k} as (
  select p, e, list(y order by i) as y
  from (select p, e, i, cast(floor(sum(x[i]) / count(*)) as bigint) as y from (select p, e, x, unnest(range(1, len(x) + 1)) as i from a{k}) group by p, e, i)
  group by p, e
), b{next} as (select p, e, coalesce(y, c) as c from b{k} left join m{k} using (p, e))"""
CODES_SQL = """
with kept as (
  select row_number() over (order by vec_id nulls last) as row, vec_id, label,
         list_transform(embedding, lambda x: cast(floor(256.0 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), parts as (
  select row, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as x from kept, range(16) as t(p)
), b0 as (select p, row - 1 as e, x as c from parts where row <= 64),""" + ",".join(
    [_NEAREST.format(k=0), _MEANS.format(k=0, next=1), _NEAREST.format(k=1), _MEANS.format(k=1, next=2), _NEAREST.format(k=2)]) + """,
coded as (
  select row, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a2 group by row
), digest as (
  select sha256(string_agg(cast(y as varchar), ',' order by p, e, i)) as codebooks_sha256
  from (select p, e, unnest(range(1, len(c) + 1)) as i, unnest(c) as y from b2)
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (row), digest
"""

SQL = {"op11_vector_codes": CODES_SQL, "op4_exact_dedup": EXACT_SQL, "op10_decontamination": CONTAMINATION_SQL}
