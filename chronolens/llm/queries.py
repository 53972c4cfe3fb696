"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    decontamination,
    exact_dedup,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    pii,
    resampling,
    simhash,
    token_output,
    toxicity,
    url_filter,
)
from .common import crc_mod, materialise

#: Ids that close a document in token files: fixed by the query's contract.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; learns from documents whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), crc_mod("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url; the list is the canonical URLs of pages on junk sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.listed_on_sites(pages))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learns from documents whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", F.size("language.shares").alias("n_languages")
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents leave every document."""
    out = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and components of those at most four bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the token files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.read_tokens(spark, token_output.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), END_ID))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those that the random field adds."""
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("added")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the rank of those drawn."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability to be labelled toxic; learns from documents whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"), "evidence")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two tokenizers end together in every document, and how common the pairs of ids are that meet there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment.align_tokenizers(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_lm_score, op2_url_filter, op3_language_id, op4_decontaminate, op5_exact_dedup, op6_line_dedup, op7_simhash,
              op8_token_ids, op9_mix_sources, op10_personal_data, op11_importance_resampling, op12_toxicity, op13_token_alignment, pipeline)
}

_SITES = ", ".join(f"'{s}'" for s in url_filter.LISTED_SITES)
_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op2_url_filter": rf"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') as path
  from pages),
named as (
  select *, nullif(regexp_replace(regexp_replace(host, '^www\.', ''), ':[0-9]*$', '') || regexp_replace(path, '/+$', ''), '') as canonical
  from parts),
list as (select distinct canonical from named where list_has_any(string_split(host, '.'), [{_SITES}])),
rules(act, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
urls as (select distinct host, path from named),
ruled as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(act, length(h || p)) as act
  from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
select n.page_id, n.host, n.path, r.rule,
  coalesce(r.act, case when l.canonical is not null then 'block' else 'allow' end) as verdict,
  n.canonical, l.canonical is not null as listed
from named n left join ruled r on n.host = r.host and n.path = r.path left join list l on n.canonical = l.canonical""",
    "op5_exact_dedup": """
with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) as kept, sha256(coalesce(text, '')) as text_sha256
from documents join g on g.t = coalesce(text, '')""",
    "op6_line_dedup": rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
keyed as (
  select doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
bad as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where k in (select k from bad)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where k not in (select k from bad)), '')) as kept_sha256
from keyed group by doc_id""",
}
