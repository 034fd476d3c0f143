"""Queries over documents, benchmark, pages and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import alignment, metrics, retrieval
from tessera.operators.durable import durable

K = 10


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _items(spark, d):
    return table(spark, d, "benchmark").select("item_id", "text")


def _ranked(spark, d, k=K):
    return retrieval.bm25_top(_docs(spark, d), _items(spark, d), "doc_id", "item_id", k)


def _gold(spark, d):
    return durable(alignment.contained(_docs(spark, d), _items(spark, d), "doc_id", "item_id"))


def chunk_words(spark, d):
    chunks = T.chunk_text(_docs(spark, d), "text", 200, 50)
    return chunks.select("doc_id", "word_offset", "word_count", F.md5("chunk_text").alias("text_md5"))


def chunk_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    chunks = T.chunk_text(docs, "text", 200, 50)
    key = T.chunk_id(F.lit("text"), F.col("doc_id").cast("string"), F.col("source"), F.col("word_offset"), F.col("chunk_text"))
    return chunks.select("doc_id", "word_offset", key.alias("chunk_id"))


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def url_metadata(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"),
        T.safe_id(url).alias("safe_id"),
        T.filing_from_name(F.regexp_extract(url, "([^/]*)$", 1))["filing_year"].alias("year"),
    )


def token_stats(spark, d):
    tokens = T.alnum_tokens(F.col("text"))
    return _docs(spark, d).select(
        "doc_id", F.size(T.words(F.col("text"))).alias("words"), F.size(tokens).alias("tokens"), T.estimate_tokens(F.col("text")).alias("estimated")
    )


def doc_frequency(spark, d):
    p = retrieval.postings(_docs(spark, d), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _rounded(ranked):
    return ranked.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark, d):
    return _rounded(_ranked(spark, d))


def tfidf_cosine_topk(spark, d):
    s = retrieval.tfidf_cosine(_docs(spark, d), _items(spark, d), "doc_id", "item_id")
    return _rounded(retrieval.top_k(s, "item_id", "doc_id", K))


def sparse_dot_topk(spark, d):
    tf = F.col("tf").cast("double").alias("weight")
    a = retrieval.postings(_docs(spark, d), "doc_id", "text").select("doc_id", "term", tf)
    b = retrieval.postings(_items(spark, d), "item_id", "text").select("item_id", "term", tf)
    return _rounded(retrieval.top_k(retrieval.sparse_dot(a, b, "doc_id", "item_id"), "item_id", "doc_id", K))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _queries20(spark, d):
    return _vectors(spark, d).filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark, d):
    top = retrieval.dense(_vectors(spark, d), _queries20(spark, d), "vec_id", "query_id", K)
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def maxsim_topk(spark, d):
    v = _vectors(spark, d)
    docs = v.select(F.floor(F.col("vec_id") / 4).alias("doc"), "embedding")
    q = v.filter(F.floor(F.col("vec_id") / 4) % 20 == 0).select(F.floor(F.col("vec_id") / 4).alias("query_id"), (F.col("vec_id") % 4).alias("token"), "embedding")
    top = retrieval.maxsim(docs, q, "doc", "query_id", K)
    return top.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def hybrid_fusion(spark, d):
    docs, items = _docs(spark, d), _items(spark, d)
    index = retrieval.kept_postings(docs, "doc_id", "text")
    lexical = retrieval.bm25_top(docs, items, "doc_id", "item_id", 2 * K)
    semantic = retrieval.tfidf_cosine(docs, items, "doc_id", "item_id", index=index)
    return _rounded(retrieval.hybrid(lexical, semantic, "doc_id", "item_id", K))


def align_contains(spark, d):
    return _gold(spark, d)


def align_jaccard(spark, d):
    a = alignment.overlapping(_docs(spark, d), _items(spark, d), "doc_id", "item_id")
    return a.select("item_id", "doc_id", F.round("score", 6).alias("score"))


def _per_query(spark, d):
    return metrics.per_query(_ranked(spark, d), _gold(spark, d), _items(spark, d), "item_id", "doc_id", (1, 5, 10))


def ir_metrics_macro_all(spark, d):
    return metrics.summary(_per_query(spark, d), "macro_all")


def ir_metrics_gold_only(spark, d):
    return metrics.summary(_per_query(spark, d), "gold_only")


def hit_at_k(spark, d):
    rows = _per_query(spark, d)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.sum((F.col("hits") > 0).cast("int")).alias("hit_queries"))


def first_gold_rank(spark, d):
    rows = _per_query(spark, d).filter(F.col("k") == 10)
    return rows.select("item_id", "n_gold", "first")


def failed_cases(spark, d):
    rows = _per_query(spark, d).filter((F.col("k") == 10) & (F.col("hits") == 0))
    return rows.select("item_id", "n_gold")


def best_method(spark, d):
    """Methods by recall at 10 over queries with gold; the best one named."""
    docs, items, gold = _docs(spark, d), _items(spark, d), _gold(spark, d)
    tfidf = retrieval.top_k(retrieval.tfidf_cosine(docs, items, "doc_id", "item_id"), "item_id", "doc_id", K)
    rows = []
    for name, r in (("bm25", _ranked(spark, d)), ("tfidf", tfidf)):
        s = metrics.summary(metrics.per_query(r, gold, items, "item_id", "doc_id", (10,)), "gold_only")
        rows.append(s.select(F.lit(name).alias("method"), "recall", "ndcg"))
    both = rows[0].union(rows[1])
    return both.agg(F.max_by("method", F.struct("recall", "ndcg", "method")).alias("best"), F.max("recall").alias("recall"))


def dedupe_best_rank(spark, d):
    ranked = durable(_ranked(spark, d).select("item_id", "doc_id", "rank"))
    again = ranked.withColumn("rank", F.col("rank") + 5)
    return retrieval.dedupe_best_rank(ranked.union(again), "item_id", "doc_id")


def replayed_ranking(spark, d):
    lists = _ranked(spark, d).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    r = retrieval.replayed(lists, "item_id", "ids", "k", 10)
    return r.select("item_id", F.col("doc").alias("doc_id"), "score", "rank")


def pre_gold_rows(spark, d):
    j = metrics.judged(_ranked(spark, d), _gold(spark, d), "item_id", "doc_id")
    return metrics.before_first_gold(j, "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("rows"))


def report_rollup(spark, d):
    """Hits by query group and k, with subtotals."""
    rows = _per_query(spark, d).withColumn("grp", (F.col("item_id") % 4).cast("int"))
    return rows.rollup("grp", "k").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_words, chunk_ids, html_to_text, url_metadata, token_stats, doc_frequency, bm25_topk, tfidf_cosine_topk, sparse_dot_topk,
        dense_topk, maxsim_topk, hybrid_fusion, align_contains, align_jaccard, ir_metrics_macro_all, ir_metrics_gold_only, hit_at_k,
        first_gold_rank, failed_cases, best_method, dedupe_best_rank, replayed_ranking, pre_gold_rows, report_rollup,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda w: w <> '')"
_TOK = r"""
dtok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM documents),
qtok AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM benchmark),
dp AS (SELECT doc_id, term, count(*) AS tf FROM dtok GROUP BY ALL),
qp AS (SELECT item_id, term, count(*) AS qtf FROM qtok GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM dp GROUP BY term)"""
_RANK = "row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id)"
_BM25 = _TOK + r""",
len AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS dl FROM documents),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
bm AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM qp JOIN dfreq USING (term) JOIN dp USING (term) JOIN len USING (doc_id), whole GROUP BY ALL)"""
_TFIDF = r""",
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM dfreq),
dw AS (SELECT doc_id, term, tf * idf AS w FROM dp JOIN idf USING (term)),
qw AS (SELECT item_id, term, qtf * idf AS w FROM qp JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY item_id),
cs AS (SELECT item_id, doc_id, sum(dw.w / dn.n * (qw.w / qn.n)) AS score
       FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)"""
_TOP = _BM25 + f", ranked AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM bm) WHERE rank <= 10)"
_GOLD = r""",
nd AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents),
ne AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS e FROM benchmark),
gold AS (SELECT item_id, doc_id FROM nd JOIN ne ON (contains(t, e) OR contains(e, t)) AND t <> '' AND e <> '')"""
_PERQ = _TOP + _GOLD + """,
ks AS (SELECT unnest([1, 5, 10])::INT AS k),
j AS (SELECT ranked.*, CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 1 END AS is_gold FROM ranked LEFT JOIN gold USING (item_id, doc_id)),
ng AS (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id),
perq AS (
  SELECT b.item_id, ks.k, coalesce(sum(CASE WHEN rank <= k THEN is_gold END), 0)::BIGINT AS hits,
         coalesce(sum(CASE WHEN rank <= k THEN 1 END), 0)::BIGINT AS retrieved,
         min(CASE WHEN is_gold = 1 THEN rank END)::INT AS first,
         coalesce(sum(CASE WHEN rank <= k AND is_gold = 1 THEN 1 / log2(rank + 1) END), 0) AS dcg,
         coalesce(any_value(ng.n), 0)::BIGINT AS n_gold
  FROM (SELECT DISTINCT item_id FROM benchmark) b CROSS JOIN ks LEFT JOIN j USING (item_id) LEFT JOIN ng USING (item_id)
  GROUP BY b.item_id, ks.k)"""
_SUM = """
SELECT k, count(*)::BIGINT AS queries, round(avg({precision}), 6) AS precision,
       round(avg(CASE WHEN n_gold > 0 THEN hits / n_gold ELSE 0 END), 6) AS recall,
       round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit,
       round(avg(coalesce(1 / first, 0)), 6) AS mrr,
       round(avg(CASE WHEN n_gold > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= least(n_gold, k)) ELSE 0 END), 6) AS ndcg
FROM perq {where} GROUP BY k"""
_SUMMARY_ALL = _SUM.format(precision="CASE WHEN retrieved > 0 THEN hits / retrieved ELSE 0 END", where="")
_SUMMARY_GOLD = _SUM.format(precision="hits / k", where="WHERE n_gold > 0")
_CHUNKS = r"""
w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT *, unnest(range(0, (greatest(ceil((len(w) - 200) / 150), 0) * 150 + 1)::BIGINT, 150)) AS off FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, source, off::INT AS word_offset, w[off + 1 : off + 200] AS p FROM s)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"

ORACLE_SQL = {
    "chunk_words": f"WITH {_CHUNKS} SELECT doc_id, word_offset, len(p)::INT AS word_count, md5(array_to_string(p, ' ')) AS text_md5 FROM c",
    "chunk_ids": f"""WITH {_CHUNKS} SELECT doc_id, word_offset, 'text::' || doc_id || '::' || source || '::' || word_offset || '::' ||
        substr(sha1(trim(regexp_replace(lower(array_to_string(p, ' ')), '\\s+', ' ', 'g'))), 1, 10) AS chunk_id FROM c""",
    "html_to_text": r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p\s*>|</div\s*>', chr(10), 'g'),
        '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS text FROM pages""",
    "url_metadata": r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
        substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS safe_id,
        CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '(?i)^([a-z.]+)[_-]((?:19|20)[0-9]{2})[_-](10-?k|10-?q|8-?k)')
             THEN regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(?i)^([a-z.]+)[_-]((?:19|20)[0-9]{2})[_-](10-?k|10-?q|8-?k)', 2)
             ELSE regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(19[0-9]{2}|20[0-9]{2})', 1) END AS year FROM pages""",
    "token_stats": r"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))::INT AS words,
        len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2)))::INT AS tokens,
        (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::INT AS estimated FROM documents""",
    "doc_frequency": f"WITH {_TOK} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM dp GROUP BY term",
    "bm25_topk": f"WITH {_TOP} SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ranked",
    "tfidf_cosine_topk": f"""WITH {_TOK}{_TFIDF} SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank
        FROM (SELECT *, {_RANK} AS rank FROM cs WHERE score > 0) WHERE rank <= 10""",
    "sparse_dot_topk": f"""WITH {_TOK}, sd AS (SELECT item_id, doc_id, sum(tf::DOUBLE * qtf) AS score FROM dp JOIN qp USING (term) GROUP BY ALL)
        SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, {_RANK} AS rank FROM sd) WHERE rank <= 10""",
    "dense_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_DOT.format(a='q.embedding', b='v.embedding')} AS score
          FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)
        SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY round(score, 8) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "maxsim_topk": f"""WITH p AS (SELECT q.vec_id // 4 AS query_id, q.vec_id % 4 AS token, v.vec_id // 4 AS doc,
            max({_DOT.format(a='q.embedding', b='v.embedding')}) AS s FROM embeddings v, embeddings q WHERE (q.vec_id // 4) % 20 = 0 GROUP BY ALL),
        t AS (SELECT query_id, doc, sum(s) AS score FROM p GROUP BY ALL)
        SELECT query_id, doc, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY round(score, 8) DESC, doc) AS rank FROM t) WHERE rank <= 10""",
    "hybrid_fusion": f"""WITH {_BM25}{_TFIDF},
        l AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM bm) WHERE rank <= 20),
        s AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM cs WHERE score > 0) WHERE rank <= 20),
        ln_ AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5::DOUBLE
                ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM l WINDOW w AS (PARTITION BY item_id)),
        sn AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5::DOUBLE
                ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM s WINDOW w AS (PARTITION BY item_id)),
        f AS (SELECT item_id, doc_id, 0.5::DOUBLE * coalesce(x, 0) + 0.5::DOUBLE * coalesce(y, 0) AS score FROM ln_ FULL JOIN sn USING (item_id, doc_id))
        SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 10""",
    "align_contains": f"WITH {_GOLD[1:]} SELECT item_id, doc_id FROM gold",
    "align_jaccard": r"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2)) AS a FROM documents),
        e AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2)) AS b FROM benchmark),
        dt AS (SELECT doc_id, len(a) AS nd, unnest(a) AS t FROM d), et AS (SELECT item_id, len(b) AS ne, unnest(b) AS t FROM e),
        sh AS (SELECT item_id, doc_id, nd, ne, count(*) AS n FROM et JOIN dt USING (t) GROUP BY ALL),
        cl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM sh),
        sc AS (SELECT item_id, doc_id, n / (nd + ne - n) AS score FROM cl WHERE r <= 200)
        SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS b FROM sc)
        WHERE b = 1 AND score >= 0.1""",
    "ir_metrics_macro_all": f"WITH {_PERQ}{_SUMMARY_ALL}",
    "ir_metrics_gold_only": f"WITH {_PERQ}{_SUMMARY_GOLD}",
    "hit_at_k": f"WITH {_PERQ} SELECT k, count(*)::BIGINT AS queries, sum((hits > 0)::INT)::BIGINT AS hit_queries FROM perq GROUP BY k",
    "first_gold_rank": f"WITH {_PERQ} SELECT item_id, n_gold, first FROM perq WHERE k = 10",
    "failed_cases": f"WITH {_PERQ} SELECT item_id, n_gold FROM perq WHERE k = 10 AND hits = 0",
    "best_method": f"""WITH {_PERQ}{_TFIDF},
        tr AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM cs WHERE score > 0) WHERE rank <= 10),
        both_ AS (SELECT 'bm25' AS method, item_id, doc_id, rank FROM ranked UNION ALL SELECT 'tfidf', item_id, doc_id, rank FROM tr),
        m AS (SELECT method, item_id, n, sum(CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 1 END) AS hits,
                     sum(CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg
              FROM both_ JOIN ng USING (item_id) LEFT JOIN gold USING (item_id, doc_id) GROUP BY ALL),
        a AS (SELECT method, round(sum(hits / n) / (SELECT count(*) FROM ng), 6) AS recall,
                     round(sum(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= least(n, 10))) / (SELECT count(*) FROM ng), 6) AS ndcg
              FROM m GROUP BY method)
        SELECT (SELECT method FROM a ORDER BY recall DESC, ndcg DESC, method DESC LIMIT 1) AS best, max(recall) AS recall FROM a""",
    "dedupe_best_rank": f"WITH {_TOP} SELECT item_id, doc_id, rank::INT AS rank FROM ranked",
    "replayed_ranking": f"WITH {_TOP} SELECT item_id, doc_id, (11 - rank)::DOUBLE AS score, rank::INT AS rank FROM ranked",
    "pre_gold_rows": f"""WITH {_PERQ}, f AS (SELECT item_id, min(CASE WHEN is_gold = 1 THEN rank END) AS first FROM j GROUP BY item_id)
        SELECT item_id, count(*)::BIGINT AS rows FROM j JOIN f USING (item_id) WHERE f.first IS NULL OR f.first = 1 OR rank < f.first GROUP BY item_id""",
    "report_rollup": f"""WITH {_PERQ} SELECT (item_id % 4)::INT AS grp, k, sum(hits)::BIGINT AS hits, count(*)::BIGINT AS n
        FROM perq GROUP BY ROLLUP ((item_id % 4)::INT, k)""",
}
