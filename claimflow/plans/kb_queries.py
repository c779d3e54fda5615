"""Registered knowledge-base queries: chunking, dimension check, exact k-NN,
incremental ingestion, retrieval-mode prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimflow.operators import kb, policy, prompts
from claimflow.plans.claim_queries import (
    POLICIES_SQL, TEMPLATES, _classify_sql, _context_sql, _policy_join_sql, _render_sql)
from claimflow.plans.registry import query
from claimflow.sources.parallel import spread
from claimflow.sources.staging import shared_path, staged
from claimflow.sources.tables import read_table

#: Best score below which a search of the knowledge base counts as empty.
MIN_SCORE = 0.6
EMBED_DIM = 64  # dimension of the given embeddings table
_WS = r"[\s\p{Z}\x0B]+"


def _docs(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents"))


def _location():
    return F.concat(F.lit("documents/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


@query("kb_chunks", f"""with w as (select doc_id, source,
   list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') as words from documents),
n as (select *, len(words) as n, case when len(words) = 0 then 0
   else greatest(cast(ceil((len(words) - 300) / 240.0) as bigint), 0) + 1 end as n_chunks from w)
select doc_id, cast(i as int) as chunk_no,
 md5(array_to_string(list_slice(words, i * 240 + 1, i * 240 + 300), ' ')) as chunk_md5,
 cast(len(list_slice(words, i * 240 + 1, i * 240 + 300)) as int) as n_words,
 'documents/' || source || '/' || cast(doc_id as varchar) || '.txt' as location
from n, range(n_chunks) t(i)""")
def kb_chunks(spark, sf_dir):
    """V1/V9: 300-word chunks with 20 % overlap, with source location."""
    d = _docs(spark, sf_dir).select("doc_id", "text", _location().alias("location"))
    c = kb.chunk_documents(d, "doc_id", "text", keep=("location",))
    return c.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"),
                    F.md5("chunk_text").alias("chunk_md5"), F.col("n_words").cast("int").alias("n_words"),
                    "location")


@query("kb_embed", f"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') as words from documents),
n as (select *, case when len(words) = 0 then 0 else greatest(cast(ceil((len(words) - 300) / 240.0) as bigint), 0) + 1 end as n_chunks from w),
c as (select doc_id, cast(i as int) as chunk_no, list_slice(words, i * 240 + 1, i * 240 + 300) as words from n, range(n_chunks) t(i)),
u as (select doc_id, chunk_no, cast('0x' || substr(md5(lower(w)), 1, 8) as bigint) % 1024 as b from (
  select doc_id, chunk_no, unnest(words) as w from c)),
f as (select doc_id, chunk_no, b, cast(count(*) as double) as n from u group by all),
l as (select doc_id, chunk_no, count(*) as n_buckets, sqrt(sum(n * n)) as len2, arg_max(b, (n, -b)) as top, max(n) as top_n
  from f group by all)
select doc_id, chunk_no, 1024 as dim, cast(n_buckets as int) as n_buckets, cast(top as int) as top_bucket,
 round(top_n / len2, 9) as top_weight from l""")
def kb_embed(spark, sf_dir):
    """V2: offline embedding of every chunk (hashed term frequencies, length 1)."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    c = kb.chunk_documents(d, "doc_id", "text")
    e = kb.embed_chunks(c, dim=1024)
    top = F.array_max("vector")
    return e.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.size("vector").alias("dim"),
                    F.size(F.filter("vector", lambda x: x > 0)).alias("n_buckets"),
                    (F.array_position("vector", top) - 1).cast("int").alias("top_bucket"),
                    F.round(top, 9).alias("top_weight"))


@query("kb_dim_check", f"""select vec_id, cast(len(embedding) as int) as dim, len(embedding) = {EMBED_DIM} as accepted
from embeddings""")
def kb_dim_check(spark, sf_dir):
    """V3: vectors of the index dimension are accepted, the rest quarantined."""
    e = read_table(spark, sf_dir, "embeddings")
    ok, bad = kb.dimension_check(e, "embedding", EMBED_DIM)
    tag = lambda d, a: d.select("vec_id", F.size("embedding").alias("dim"), F.lit(a).alias("accepted"))
    return tag(ok, True).unionByName(tag(bad, False))


def _knn(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    q = kb.label_centroids(e, "label", "embedding", "qvec").withColumnRenamed("label", "qid")
    return kb.knn_topk(e, q.select(F.col("qid").cast("long").alias("qid"), "qvec"), k=5)


@query("knn_top5", """with x as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label, list(a order by i) as q from (select label, i, avg(cast(v as double)) as a from x group by label, i) group by label),
d as (select c.label as qid, e.vec_id, list_distance(cast(e.embedding as double[]), c.q) as dist from c cross join embeddings e),
r as (select *, row_number() over (partition by qid order by dist, vec_id) as rank from d)
select cast(qid as bigint) as qid, cast(rank as int) as rank, vec_id, round(dist * dist, 6) as d2 from r where rank <= 5""")
def knn_top5(spark, sf_dir):
    """V5/K4: exact top-5 nearest embeddings for each label centroid."""
    return _knn(spark, sf_dir).select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("d2", 6).alias("d2"))


def _vector_index(spark, sf_dir):
    """An inverted-file index over the embeddings, and as queries every row whose id 50 divides."""
    e = read_table(spark, sf_dir, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return kb.IvfIndex.build(e, shared_path(spark, "embedding-index")), queries, e


@query("knn_index_exact", """with q as (select vec_id as qid, cast(embedding as double[]) as q from embeddings where vec_id % 50 = 0),
d as (select qid, vec_id, list_distance(cast(embedding as double[]), q) as dist from q cross join embeddings)
select qid, cast(row_number() over (partition by qid order by dist, vec_id) as int) as rank, vec_id, round(dist * dist, 6) as d2
from d qualify rank <= 5""")
def knn_index_exact(spark, sf_dir):
    """V5/V6: exact top-5 through the inverted-file index: all its lists, pruned by the triangle inequality."""
    index, queries, _ = _vector_index(spark, sf_dir)
    return index.search(queries, k=5).select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("d2", 6).alias("d2"))


@query("knn_approx")
def knn_approx(spark, sf_dir):
    """V6: approximate top-5 through the inverted-file index. The number of
    lists to probe is fitted for a recall of 0.95 on rows that are no queries."""
    index, queries, e = _vector_index(spark, sf_dir)
    held_out = e.where(F.col("vec_id") % 50 == 25).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    probes = index.probes_for_recall(held_out, k=5, target=0.95)
    return index.search(queries, k=5, probes=probes).select(
        "qid", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("d2", 6).alias("d2"))


def _hashed(spark, sf_dir):
    """Every document's content hash; the labelled documents are in the index."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    return kb.hashed_documents(read_table(spark, sf_dir, "documents"), labels, keep=("source",))


_NEW_DOCS_SQL = """with inc as (select sha256(text) as content_hash, min(doc_id) as doc_id from documents group by 1),
idx as (select distinct sha256(text) as content_hash from documents where doc_id in (select doc_id from labels))
select content_hash, doc_id from inc where content_hash not in (select content_hash from idx)"""


@query("kb_new_docs", _NEW_DOCS_SQL)
def kb_new_docs(spark, sf_dir):
    """New distinct documents to index (content hash not yet indexed)."""
    return kb.new_documents(_hashed(spark, sf_dir)).select("content_hash", "doc_id")


@query("kb_ingest_stats", f"""with nd as ({_NEW_DOCS_SQL}),
bad as (select conv_id from conversations where role not in ('user', 'assistant'))
select (select count(*) from documents) + (select count(*) from bad) as documents_scanned,
 (select count(*) from nd) as new_documents_indexed,
 (select count(*) from documents) - (select count(*) from nd) as documents_skipped,
 (select count(*) from bad) as documents_failed,
 case when (select count(*) from bad) > 0 then 'unknown role' else '' end as failure_reasons, 'COMPLETE' as status""")
def kb_ingest_stats(spark, sf_dir):
    """Scanned / new / skipped / failed counts of one ingestion run. The
    corpus is the documents; conversation turns of an unknown role come along
    as files that cannot be ingested."""
    turns = read_table(spark, sf_dir, "conversations")
    failures = turns.where(~F.col("role").isin("user", "assistant")).select(F.lit("unknown role").alias("reason"))
    stats = kb.ingest_stats(_hashed(spark, sf_dir), failures)
    return stats.withColumn("failure_reasons", F.array_join("failure_reasons", ", "))


_RETRIEVAL_SQL = f"""w as (select doc_id, 'documents/' || source || '/' || cast(doc_id as varchar) || '.txt' as location, lang,
   list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') as words from documents),
n as (select *, case when len(words) = 0 then 0 else greatest(cast(ceil((len(words) - 300) / 240.0) as bigint), 0) + 1 end as n_chunks from w),
c as (select doc_id, i as chunk_no, location, lang, list_slice(words, i * 240 + 1, i * 240 + 300) as words from n, range(n_chunks) t(i)),
q as (select item_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') as words from benchmark),
cf as (select doc_id, chunk_no, cast('0x' || substr(md5(lower(w)), 1, 8) as bigint) % 1024 as b, cast(count(*) as double) as n
  from (select doc_id, chunk_no, unnest(words) as w from c) group by all),
qf as (select item_id, cast('0x' || substr(md5(lower(w)), 1, 8) as bigint) % 1024 as b, cast(count(*) as double) as n
  from (select item_id, unnest(words) as w from q) group by all),
cl as (select doc_id, chunk_no, sqrt(sum(n * n)) as len from cf group by all),
ql as (select item_id, sqrt(sum(n * n)) as len from qf group by all),
dots as (select item_id, doc_id, chunk_no, sum(cf.n * qf.n) as dot from cf join qf using (b) group by all),
dist as (select ql.item_id, cl.doc_id, cl.chunk_no, 2 - 2 * coalesce(dot, 0) / (ql.len * cl.len) as d2
  from ql cross join cl left join dots on dots.item_id = ql.item_id and dots.doc_id = cl.doc_id and dots.chunk_no = cl.chunk_no),
r as (select *, row_number() over (partition by item_id order by round(d2, 12), doc_id, chunk_no) as rank from dist)"""


def _retrieval(spark, sf_dir, k=5):
    """Benchmark passages as queries against embedded document chunks. Chunks
    are told apart by (doc_id, chunk_no); only the documents of the winners
    are chunked a second time, for their contents."""
    docs = read_table(spark, sf_dir, "documents")
    emb = kb.embed_chunks(kb.chunk_documents(spread(docs), "doc_id", "text"), dim=1024)
    qs = kb.embed_chunks(read_table(spark, sf_dir, "benchmark").withColumnRenamed("text", "chunk_text"), dim=1024)
    rounded = emb.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "vector")
    knn = kb.knn_topk(rounded, qs.select(F.col("item_id").alias("qid"), F.col("vector").alias("qvec")),
                      k=k, id_col=("doc_id", "chunk_no"), vec_col="vector")
    # Used twice below: written, so that chunks are embedded and searched once.
    knn = staged(knn, "kb-winners")
    # k rows per query: the text side stays where it is and is filtered.
    won = knn.select("doc_id").distinct()
    full = docs.join(won, "doc_id", "left_semi").withColumn("location", _location())
    chunks = kb.chunk_documents(full, "doc_id", "text", keep=("location", "lang"))
    chunks = chunks.withColumn("chunk_no", F.col("chunk_no").cast("long"))
    return kb.retrieval_results(knn, chunks, ("doc_id", "chunk_no"), "chunk_text", "location", {"lang": "lang"})


@query("kb_retrieval", f"""with {_RETRIEVAL_SQL}
select item_id as qid, count(*) as n_results, arg_min(location, rank) as top_location, round(1 / (1 + min(d2)), 6) as top_score,
 md5(string_agg(array_to_string(c.words, ' '), chr(10) order by rank)) as contents_md5,
 '{{"lang":"' || arg_min(lang, rank) || '"}}' as top_metadata
from r join c using (doc_id, chunk_no) where rank <= 5 group by item_id""")
def kb_retrieval(spark, sf_dir):
    """V5: top-5 chunks (content, score, location, metadata) per benchmark passage."""
    r = _retrieval(spark, sf_dir)
    top = F.col("results")[0]
    return r.select("qid", F.size("results").cast("long").alias("n_results"), top["location"].alias("top_location"),
                    F.round(top["score"], 6).alias("top_score"),
                    F.md5(F.array_join(F.transform("results", lambda x: x["content"]), "\n")).alias("contents_md5"),
                    top["metadata"].alias("top_metadata"))


_ENRICHED_KB_SQL = f"""{_RETRIEVAL_SQL},
ctx as (select item_id, chr(10) || 'POLICY CONTEXT FROM KNOWLEDGE BASE:' || chr(10) ||
  string_agg(chr(10) || cast(rank as varchar) || '. ' || array_to_string(c.words, ' ') || chr(10), '' order by rank) as context
  from r join c using (doc_id, chunk_no) where rank <= 3 group by item_id),
p as (select item_id, context, {_render_sql(TEMPLATES['extract_info'], document_text='text')} as base from benchmark join ctx using (item_id))"""


@query("prompt_enriched_kb", f"""with {_ENRICHED_KB_SQL}
select item_id as qid, context || base as enriched_prompt, cast(length(base) as int) as base_length,
 cast(length(context || base) as int) as enriched_length, cast(length(context) as int) as context_added from p""")
def prompt_enriched_kb(spark, sf_dir):
    """M7: retrieval-mode prompt (top 3 of 5 chunks numbered) before the
    extraction prompt of the passage."""
    r = _retrieval(spark, sf_dir)
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    j = r.join(q, "qid")
    j = j.withColumn("base_prompt", prompts.DEFAULT_TEMPLATES.render("extract_info", document_text="text"))
    e = prompts.enrich_prompt(j, "base_prompt", prompts.kb_context_block("results", 3))
    return e.select("qid", "enriched_prompt", "enrichment_stats.*")


@query("context_with_fallback", f"""with {_ENRICHED_KB_SQL},
m as (select p.item_id, case when (select round(1 / (1 + min(d2)), 6) from r where r.item_id = p.item_id) >= {MIN_SCORE} then context end as kb, {_classify_sql('text')} as claim_type from benchmark join p using (item_id)),
policies as ({POLICIES_SQL}), j as ({_policy_join_sql('m')})
select item_id as qid, case when kb is not null then 'bedrock_kb' else 'fallback' end as source,
 case when kb is not null then true else false end as is_complete, md5(coalesce(kb, {_context_sql()})) as context_md5 from j""")
def context_with_fallback(spark, sf_dir):
    """Passages whose best result in the knowledge base scores
    ``MIN_SCORE`` or more take their context from it and count as complete;
    the others fall back to the policy of their claim type."""
    asked = _retrieval(spark, sf_dir).where(F.round(F.col("results")[0]["score"], 6) >= MIN_SCORE)
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    j = q.join(asked, "qid", "left").withColumn("claim_type", policy.classify_claim("text"))
    j = policy.policy_lookup(j, "claim_type")
    out = kb.context_with_fallback(j, "results", {"fallback_context": prompts.policy_context_block()})
    out = policy.kb_validation(out, "results")
    has = F.col("source") == policy.KB_SOURCE
    return out.select("qid", "source", F.when(has, F.col("validation.is_complete")).otherwise(F.lit(False)).alias("is_complete"),
                      F.md5(F.when(has, prompts.kb_context_block("results", 3)).otherwise(F.col("fallback_context"))).alias("context_md5"))


_KNN_SQL_BODY = """x as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label, list(a order by i) as q from (select label, i, avg(cast(v as double)) as a from x group by label, i) group by label),
d as (select c.label as qid, e.vec_id, e.label as vlabel, list_distance(cast(e.embedding as double[]), c.q) as dist
      from c cross join embeddings e),
r as (select *, row_number() over (partition by qid order by dist, vec_id) as rank from d)"""


@query("prompt_context_kb", f"""with {_KNN_SQL_BODY}
select cast(qid as bigint) as qid, chr(10) || 'POLICY CONTEXT FROM KNOWLEDGE BASE:' || chr(10) ||
  string_agg(chr(10) || cast(rank as varchar) || '. vector ' || cast(vec_id as varchar) || ' (label ' ||
             cast(vlabel as varchar) || ')' || chr(10), '' order by rank) as context
from r where rank <= 3 group by qid""")
def prompt_context_kb(spark, sf_dir):
    """M7: retrieval-mode context block (top 3 of the 5 retrieved items,
    numbered) for each label-centroid query over the embeddings."""
    e = read_table(spark, sf_dir, "embeddings")
    knn = _knn(spark, sf_dir)
    items = knn.join(e.select("vec_id", "label"), "vec_id").withColumn(
        "content", F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" (label "),
                            F.col("label").cast("string"), F.lit(")")))
    # at most k = 5 rows per query: the collected list is bounded
    res = items.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("results"))
    return res.select("qid", prompts.kb_context_block("results", 3).alias("context"))


@query("latest_ingestion", """with lab as (select * from documents where doc_id in (select doc_id from labels)),
idx as (select distinct sha256(text) as h from lab),
r1 as (select source, 1 as run_id, count(*) as documents_scanned, count(distinct sha256(text)) as new_documents_indexed
       from lab group by source),
g as (select source, sha256(text) as h, count(*) as n from documents group by 1, 2),
r2 as (select source, 2 as run_id, sum(n) as documents_scanned,
       count(*) filter (where h not in (select h from idx)) as new_documents_indexed from g group by source),
a as (select * from r1 union all select * from r2)
select source, max(run_id) as run_id, cast(arg_max(documents_scanned, run_id) as bigint) as documents_scanned,
 cast(arg_max(new_documents_indexed, run_id) as bigint) as new_documents_indexed from a group by source""")
def latest_ingestion(spark, sf_dir):
    """K6 + A13: two sync runs per data source (each document ``source``):
    run 1 indexes the labelled documents, run 2 syncs the whole corpus against
    them; the audit table keeps both and each source's latest run is shown."""
    from claimflow.sources.sinks import latest_run_per_source
    hashed = _hashed(spark, sf_dir)
    run1 = kb.ingest_stats_by_source(hashed.where("in_index").withColumn("in_index", F.lit(False)))
    run2 = kb.ingest_stats_by_source(hashed)
    audit = run1.withColumn("run_id", F.lit(1)).unionByName(run2.withColumn("run_id", F.lit(2)))
    return latest_run_per_source(audit, "source", "run_id").select(
        "source", "run_id", "documents_scanned", "new_documents_indexed")
