"""Two-stage hybrid retrieval: exact nearest neighbours, BM25, rank fusion, normalisers, thresholds, rerank, context.

Single queries are one scan each: the vector and the terms of a query are literals, so nothing is joined or exploded;
corpus statistics are scalar subqueries. Ties go to the smaller id everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X

K1, B = 1.2, 0.75
RRF_K, RRF_CUT, RERANK_CUT, MOST = 60, 0.015, 0.5, 10


def knn(df: DataFrame, key: str, embedding: str, query: Sequence[float], k: int) -> DataFrame:
    """``key, score``: the ``k`` rows most similar to the query vector, by cosine; the filter belongs before this.

    Vectors that are null, of another length or all zero take no part.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    fit = df.filter(F.col(embedding).isNotNull() & (F.size(embedding) == len(query)))
    scored = fit.select(key, X.cosine(F.col(embedding), q).alias("score")).filter("score is not null and not isnan(score)")
    return scored.orderBy(F.desc("score"), key).limit(k)


def analysed(text: Column) -> Column:
    """Terms of a text: lower-case words, CJK characters one by one."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"([\x{4e00}-\x{9fff}])", " $1 "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25_scores(df: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """``key, score`` of the rows that hold one of the terms (OR), k1 = 1.2, b = 0.75."""
    terms = list(dict.fromkeys(terms))
    words = df.select(key, analysed(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    # One pass per row: keep the query's terms, then count each. Inlined as an array of one, since filters on the counts
    # would otherwise be pushed down with the analysis of the text inside them, once per term.
    once = F.struct(F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(*terms)).alias("h"))
    hits = words.select(key, F.inline(F.array(once)))
    tf = hits.select(key, "dl", *[_occurrences("h", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    whole = stats.select(F.struct(*stats.columns)).scalar()  # one subquery, read for every statistic
    one = lambda c: whole[c]
    score = F.lit(0.0)
    for i in range(len(terms)):
        f = F.col(f"tf{i}")
        idf = F.log(1 + (one("n") - one(f"df{i}") + 0.5) / (one(f"df{i}") + 0.5))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / one("avgdl")))).otherwise(0.0)
    found = F.lit(False)
    for i in range(len(terms)):
        found = found | (F.col(f"tf{i}") > 0)
    return tf.filter(found).select(key, score.alias("score"))


def bm25(df: DataFrame, key: str, text: str, terms: Sequence[str], k: int) -> DataFrame:
    return bm25_scores(df, key, text, terms).orderBy(F.desc("score"), key).limit(k)


def multi_field(df: DataFrame, key: str, boosts: dict[str, float], terms: Sequence[str], k: int) -> DataFrame:
    """BM25 per field times its boost, summed; top ``k``."""
    parts = [bm25_scores(df, key, field, terms).withColumn("score", F.col("score") * boost) for field, boost in boosts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """1-based ``rank`` in a hit list (bounded by its k)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """``key, score``: reciprocal rank fusion of hit lists."""
    out = None
    for hits in lists:
        r = ranked(hits, key).select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("score"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(key).agg(F.sum("score").alias("score"))


# ---- normalisers, over all rows or within groups


def _over(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by)


def minmax(score: Column, by: Sequence[str]) -> Column:
    lo, hi = F.min(score).over(_over(by)), F.max(score).over(_over(by))
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def zscore(score: Column, by: Sequence[str]) -> Column:
    """Sample standard score, clamped to [-1, 1]; 0 where all are equal."""
    sd, n = F.stddev_samp(score).over(_over(by)), F.count(score).over(_over(by))
    sd = F.when(n == 1, F.lit(1.0)).otherwise(sd)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (score - F.avg(score).over(_over(by))) / sd)))


def percentile(score: Column, by: Sequence[str]) -> Column:
    """Place in ascending order over n - 1; equal scores all take the last place."""
    upto = F.count(score).over(Window.partitionBy(*by).orderBy(score).rangeBetween(Window.unboundedPreceding, 0))
    n = F.count(score).over(_over(by))
    return F.when(n == 1, F.lit(1.0)).otherwise((upto - 1) / (n - 1))


NORMALISERS = {"minmax": minmax, "zscore": zscore, "percentile": percentile, "none": lambda score, by: score}


def normalise(df: DataFrame, score: str, by: Sequence[str], how: str = "minmax") -> DataFrame:
    return df.withColumn("normal", NORMALISERS.get(how, NORMALISERS["none"])(F.col(score), by))


# ---- after fusion


def rerank_cut(df: DataFrame, raw: str, key: str, by: Sequence[str], cut: float = RERANK_CUT, most: int = MOST) -> DataFrame:
    """Sigmoid of the reranker's score (0 where it is missing), those of at least ``cut``, the best ``most`` per group."""
    s = df.withColumn("score", X.sigmoid(F.coalesce(F.col(raw), F.lit(0.0)))).filter(F.col("score") >= cut)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def attach_scores(chunks: DataFrame, replies: DataFrame, on: str) -> DataFrame:
    """A reranker's reply joined by index or by text; chunks it left out get 0; of a text given twice the last counts."""
    last = replies.groupBy(on).agg(F.max_by("score", "place").alias("rerank"))
    return chunks.join(last, on, "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


def neighbour_pages(pages: Column, window: int = 1) -> Column:
    """Distinct pages within ``window`` of the given ones, none below 1."""
    spread = F.flatten(F.transform(pages, lambda p: F.sequence(p - window, p + window)))
    return F.array_sort(F.array_distinct(F.filter(spread, lambda p: p > 0)))


def context(df: DataFrame, order: Column, doc_title: str, path: str, snippet: str) -> DataFrame:
    """One row: the context blocks of the hits in order, a blank line between them."""
    block = X.context_block(F.col(doc_title), F.col(path), F.col(snippet))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def rag_search(router: DataFrame, chunks: DataFrame, query: Sequence[float], terms: Sequence[str], *, kb_ids: Sequence[str], fd_ids: Sequence[str] = (), route_k: int = 5, hits: int = 100, topk: int = 5) -> DataFrame:
    """``chunk_id, doc_id, score, rank``: route documents, search their chunks by vector and text, fuse, cut, order.

    ``router`` has kb_id, fd_id, doc_id, embedding, ``chunks`` chunk_id, doc_id, text, embedding. Filters stand before
    every top-k. ``topk`` None or below 1 counts as 5; at most ten rows come out. Raises ValueError without kb_ids.
    """
    if not kb_ids:
        raise ValueError("kb_ids is required")
    topk = topk if topk and topk > 0 else 5
    allowed = router.filter(F.col("kb_id").isin(*kb_ids))
    if fd_ids:
        allowed = allowed.filter(F.col("fd_id").isin(*fd_ids))
    routed = knn(allowed, "doc_id", "embedding", query, route_k).select("doc_id")
    near = chunks.join(F.broadcast(routed), "doc_id", "left_semi")  # route_k rows
    both = fuse([knn(near, "chunk_id", "embedding", query, hits), bm25(near, "chunk_id", "text", terms, hits)], "chunk_id")
    best = both.filter(F.col("score") >= RRF_CUT).orderBy(F.desc("score"), "chunk_id").limit(min(topk, MOST))
    return ranked(best, "chunk_id").join(chunks.select("chunk_id", "doc_id"), "chunk_id")
