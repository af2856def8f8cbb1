"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, mixing, oracles, quality, toxicity
from .divergence import audit_sources
from .embeddings import link_vectors
from .inner_products import top_products
from .labelled import held_out
from .licenses import scan_licenses
from .main_text import extract_pages
from .packing import pack_documents
from .prefix_trie import conversation_trie
from .simhash import near_duplicates
from .token_counts import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024, keep=["doc_id"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), distance=3, words=3, keep=["doc_id"])


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, threshold=0.3, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def pieces_with_crc(docs: DataFrame, tokenizer: str) -> DataFrame:
    pieces = pack_documents(docs, tokenizer, end_id=2, size=4096)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_with_crc(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64.0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, threshold=0.7, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("blocks")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # A conversation is a tree without branches: each row answers the one before it.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.select(
        F.col("conv_id").alias("tree"), place.alias("node"), F.when(place > 1, place - 1).alias("parent"),
        "role", "text", F.lit(1.0).alias("score"),
    )
    formatted = chat.format_paths(chat.best_paths(messages))
    turns = chat.parse(F.col("formatted"))
    told = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_mask")), "")
    return formatted.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least=30, k=50)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts, op2_simhash, op3_embeddings, op4_toxicity, op5_packing, op6_products, op7_quality, op8_mixing,
        op9_licenses, op10_chat, op11_prefix_trie, op12_html_extraction,
        op13_divergence,
    )
    return {f.__name__: f for f in every}


_SIZED = r"""
sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(text, '')) as digest from documents
)"""

OP8 = f"""
with recursive {_SIZED}, sources as (
  select source, sum(size)::bigint as source_size, count(*) as docs,
         (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight
  from sized group by source
), level as (
  -- Sources by the level at which they are full: the first that is not full gives the level.
  select source, source_size, weight,
         (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0))
           / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as l
  from sources
  window before as (order by source_size / weight::double, source rows between unbounded preceding and 1 preceding)
), chosen as (
  select coalesce(arg_min(l, source_size / weight::double) filter (3 * source_size >= l * weight), 0) as l from level
), targets as (
  select s.*, case when 3 * source_size < l * weight then (3 * source_size)::double else l * weight end as target
  from sources s, chosen
), rated as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 1.0 end as rate,
         ('0x' || md5('mix:' || coalesce(d.doc_id::varchar, '') || ':' || d.digest)[1:8])::bigint as h,
         coalesce('=' || d.source, 'null') as key, t.docs
  from sized d join targets t on d.source is not distinct from t.source
), placed as (
  select *, h % ceil(docs / 4096.0)::bigint as stratum,
         row_number() over (partition by key, h % ceil(docs / 4096.0)::bigint order by size desc, h, doc_id) as place
  from rated
), drawn as (
  select *, ('0x' || md5('mix:' || key || ':' || stratum::varchar)[1:8])::bigint / 4294967296.0::double as u, rate - floor(rate) as f
  from placed
)
select doc_id, size, source_size, target,
       (size * (floor(rate) + floor(u + place * f) - floor(u + (place - 1) * f))::bigint)::bigint as taken
from drawn
"""

_CONTROL = [("'" + s + "'", "'" + s[0] + "\\" + s[1:] + "'") for s in chat.CONTROL]


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for plain, marked in _CONTROL:
        sql = f"replace({sql}, {plain}, {marked})"
    return sql


OP10 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, r nulls first, t nulls first)) as loss_sha256,
       sum(length('<|im_start|>' || {_escaped("role")} || '<|im_sep|>' || {_escaped("text")} || '<|im_end|>') + 1)::bigint as formatted_chars
from rows group by conv_id
"""


OP3 = """
with v as (
  select vec_id, embedding, label,
         label is not null and coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0, false)
           and len(list_filter(embedding, lambda x: x <> 0)) > 0 as usable
  from embeddings
), u as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from v where usable
), links as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), recursive_reach as (
  with recursive reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
  select a, min(b) as b from reach group by a
)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, least(v.vec_id, coalesce(r.b, v.vec_id)) as component_id,
       v.vec_id = least(v.vec_id, coalesce(r.b, v.vec_id)) as kept
from v left join (select a, count(*) as n from links group by a) n on n.a = v.vec_id left join recursive_reach r on r.a = v.vec_id
"""

OP6 = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0, false)
), scored as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 20
"""


def llm_oracles() -> dict[str, str]:
    return {"op3_embeddings": OP3, "op6_products": OP6, "op8_mixing": OP8, "op10_chat": OP10, "op11_prefix_trie": oracles.OP11, "op13_divergence": oracles.OP13}
