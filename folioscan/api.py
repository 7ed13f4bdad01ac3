"""Search and feedback entry points over document tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.vectors import embedder
from folioscan.operators import aggregates, filters, fusion, lexical, monitoring, nearest


class Corpus:
    """Batch search over documents(doc_id, text, source, lang, ...).

    Every search takes queries(query_id, query_text) and returns one ranked list per query; vectors come
    from a column named `vector` if there is one, else from the named embedding model.
    """

    def __init__(self, documents: DataFrame, model: str = "hashing-64", clicks: DataFrame | None = None):
        self.documents = documents
        self.clicks = clicks
        self._embed = embedder(model)

    def _scope(self, where: Mapping[str, object] | None) -> DataFrame:
        return filters.where_all(self.documents, where or {})

    def _tokens(self, where) -> DataFrame:
        return lexical.tokenised(self._scope(where), "doc_id", F.col("text"))

    def search_fulltext(self, queries: DataFrame, k: int = 5, where: Mapping[str, object] | None = None, match: str = "any") -> DataFrame:
        return lexical.rank_top_k(lexical.bm25(queries, self._tokens(where), match), k)

    def search_semantic(
        self, queries: DataFrame, k: int = 5, min_similarity: float = 0.3, where: Mapping[str, object] | None = None
    ) -> DataFrame:
        docs = self._scope(where)
        vector = F.col("vector") if "vector" in docs.columns else self._embed(F.col("text"))
        q_vector = F.col("vector") if "vector" in queries.columns else self._embed(F.col("query_text"))
        asked = queries.filter(F.regexp_replace("query_text", r"\s", "") != "")
        hits = nearest.top_k_similar(
            asked.select("query_id", q_vector.alias("vector")),
            docs.select(F.col("doc_id").alias("chunk_id"), vector.alias("vector")), k, min_similarity,
        )
        return hits.withColumnRenamed("chunk_id", "doc_id")

    def search_hybrid(
        self, queries: DataFrame, k: int = 5, rrf_k: int = 60, min_similarity: float = 0.3,
        where: Mapping[str, object] | None = None, since: Column | None = None,
    ) -> DataFrame:
        """Rank fusion of both searches; with clicks and `since`, reranked by the click-trained linear model."""
        deep = 3 * k
        lex = self.search_fulltext(queries, deep, where)
        fused = fusion.reciprocal_rank_fusion(lex, self.search_semantic(queries, deep, min_similarity, where), deep, rrf_k)
        if self.clicks is None or since is None:
            return fused.filter(F.col("rank") <= k)
        first_line = F.get(F.split("text", "\n"), F.lit(0))
        docs = self.documents.select("doc_id", "text", F.col("source").alias("title"), first_line.alias("heading"))
        rows = fused.join(queries.select("query_id", "query_text"), "query_id").join(docs, "doc_id").withColumns(
            {"original_score": F.col("rrf_score"), "bm25_score": F.lit(0.0), "semantic_similarity": F.lit(0.0)}
        )
        ranked = fusion.rerank(fusion.ranking_features(rows, fusion.click_features(self.clicks, since)))
        return ranked.filter(F.col("new_rank") <= k).select("query_id", "doc_id", "score", F.col("new_rank").alias("rank"))

    def get_document(self, doc_id) -> DataFrame:
        return self.documents.filter(F.col("doc_id") == doc_id).drop("vector")

    def list_resources(self, after="", limit: int = 100, key: str = "path") -> DataFrame:
        return filters.keyset_page(self.documents.drop("vector", "text"), key, after, limit)

    def list_sources(self) -> DataFrame:
        return self.documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def click_stats(clicks: DataFrame, moment: Column, days: int = 30, by_query: bool = False) -> DataFrame:
    return aggregates.click_stats(filters.within(clicks, "ts", moment, days=days), ["query"] if by_query else [])


def update_model(clicks: DataFrame, moment: Column, learning_rate: float = 0.01) -> DataFrame:
    return fusion.updated_weights(clicks, moment - F.make_interval(days=F.lit(7)), learning_rate)


def metrics_summary(requests: DataFrame, moment: Column, hours: int = 24) -> DataFrame:
    return monitoring.request_summary(filters.within(requests, "ts", moment, hours=hours), hours)


def list_jobs(job_events: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest state per job of job_events(job_id, ts, event_id, status), newest first."""
    state = job_events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at")
    )
    chosen = state if status is None else state.filter(F.col("status") == status)
    return chosen.orderBy(F.desc("created_at"), "job_id").limit(limit)
