"""The thin queries over the driver's tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pivolith.llm import bpe, embeddedup, html, langid, linededup, neardup, packing, quality, substring, urlfilter
from pivolith.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=("n_words", "n_removed", "kept_sha256")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("n_lines_before").alias("n_lines"), F.col("n_lines_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def queries() -> dict:
    named = (op1_url_filter, op2_substring_dedup, op3_best_fit_packing, op4_line_dedup, op5_minhash_near_dedup, op6_quality_rules, op7_language_id, op8_embedding_near_dedup, op9_html_extraction, op10_bpe)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
with r as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, {_ASCII.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from r
), j as (
  select page_id, host, path, (
    select rule from (values ('org', '/', 'org/'), ('example.org', '/es/', 'example.org/es/'), ('example.org', '/en/1', 'example.org/en/1'), ('com', '/fr/', 'com/fr/'), ('com', '/de/', 'com/de/')) t(rh, rp, rule)
    where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rule) desc limit 1) as rule
  from h
)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when regexp_matches('.' || host || path, '{"|".join(f"(?:{urlfilter.as_regex(g)})" for g in urlfilter.blocked_globs())}') then 'block' else 'allow' end as verdict
from j
"""

_REACH = """
), reach(x, y) as (
  select id, id from n union select reach.x, links.b from reach join links on reach.y = links.a
), least as (
  select x as id, min(y) as component_id from reach group by x
)
"""

_OP5 = f"""
with recursive w as (
  select doc_id as id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as words from documents
), s as (
  select distinct id, array_to_string(words[p + 1 : p + 2], ' ') as g from (select id, words, unnest(range(greatest(len(words) - 1, least(len(words), 1)))) as p from w)
), n as (
  select w.id, count(s.g) as n from w left join s using (id) group by w.id
), both_ as (
  select x.id as a, y.id as b, count(*) as c from s x join s y on x.g = y.g and x.id <> y.id group by all
), links as (
  select a, b from both_ join n x on x.id = a join n y on y.id = b where 100 * c >= 80 * (x.n + y.n - c)
{_REACH}
select id as doc_id, n as n_shingles, component_id, id = component_id as kept from n join least using (id)
"""

_OP8 = f"""
with recursive n as (
  select vec_id as id, cast(embedding as double[]) as v from embeddings
), links as (
  select x.id as a, y.id as b from n x join n y on x.id <> y.id where list_cosine_similarity(x.v, y.v) >= 0.95
{_REACH}
select id as vec_id, cast((select count(*) from links where a = id) as bigint) as n_links, component_id, id = component_id as kept from n join least using (id)
"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_url_filter": _OP1, "op2_substring_dedup": substring.ORACLE, "op4_line_dedup": linededup.oracle(), "op5_minhash_near_dedup": _OP5, "op8_embedding_near_dedup": _OP8}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
