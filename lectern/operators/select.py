"""Balanced selection from rankings, and the context budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.search import Index, bm25_search, bm25_top, bm25_top_kinds, candidate_limits
from lectern.sources.store import bounded, cut

TOTAL_CHARS, SOURCE_CHARS, POOL = 16_000, 4000, 20


def dedupe_hits(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """RNK9: the first of each chunk in a query."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy(rank)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def interleave(hits: DataFrame, limit: Column | int, group: str = "group_idx", rank: str = "rank") -> DataFrame:
    """RNK8, SET1: round robin over the groups of a query by rank, a chunk once, at most ``limit``; ``position`` starts at 1."""
    order = [F.col(rank), F.col(group)]
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("_n = 1").drop("_n")
    rows = once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return rows.where(F.col("position") <= limit)


def topic_balanced(hits: DataFrame, limit: Column | int, topics: str = "topics", rank: str = "rank") -> DataFrame:
    """RNK10: with several topics, rounds of the best unused hit of each topic in request order, then the others by rank."""
    idx = F.array_position(topics, F.col("legal_topic"))
    balanced = (F.size(topics) > 1) & (F.coalesce(idx, F.lit(0)) > 0)
    rows = hits.withColumns({"_in": balanced, "_t": F.when(balanced, idx)})
    rows = rows.withColumn("_k", F.when(F.col("_in"), F.row_number().over(Window.partitionBy("query_id", "_in", "legal_topic").orderBy(rank))))
    order = Window.partitionBy("query_id").orderBy(F.desc("_in"), F.col("_k"), F.col("_t"), F.col(rank))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("_in", "_t", "_k")


def retrieve_per_topic(queries: DataFrame, chunks: DataFrame, index: Index, boosts: dict[str, float], pool: int = POOL) -> DataFrame:
    """RNK11: ``queries(query_id, query, topics, limit)``: a ranking for each topic, interleaved, then balanced; one broad ranking if no topic finds anything.

    ``index`` keeps ``legal_topic`` as ``kind``: each shard ranks the chunks of one topic, so only pages leave it.
    """
    topical = queries.select("query_id", F.posexplode("topics").alias("group_idx", "kind"))
    page = bm25_top_kinds(queries.select("query_id", "query", F.lit(True).alias("filtered")), index, boosts, topical, pool)
    ranked = page.join(topical, ["query_id", "kind"]).select("query_id", "group_idx", "chunk_id", F.col("kind").alias("legal_topic"), "score", "rank")
    # read twice: queries that it leaves without a hit are ranked broadly
    joined = cut(interleave(ranked, pool).withColumn("rank", F.col("position")).drop("position"), "topical")
    broad = cut(bm25_top(queries.select("query_id", "query").join(joined.select("query_id").distinct(), "query_id", "left_anti"), index, boosts, pool), "broad")
    broad = chunks.select("chunk_id", "legal_topic").join(bounded(broad), "chunk_id").select("query_id", F.lit(0).alias("group_idx"), "chunk_id", "legal_topic", "score", "rank")
    both = joined.unionByName(broad).join(queries.select("query_id", "topics", "limit"), "query_id")
    return topic_balanced(both, F.col("limit"))


def retrieve_multi_country(queries: DataFrame, chunks: DataFrame, index: Index, boosts: dict[str, float]) -> DataFrame:
    """RNK12: ``queries(query_id, query, codes, max_sources)``: a ranking for each country with its share, interleaved; one global ranking without countries."""
    n = F.size("codes")
    share, _ = candidate_limits(F.col("max_sources"), n)
    rows = queries.withColumn("share", F.when(n > 0, share).otherwise(F.col("max_sources")))
    slots = rows.select("query_id", "share", "max_sources", F.posexplode(F.when(n > 0, F.col("codes")).otherwise(F.array(F.lit(None).cast("string")))).alias("group_idx", "code"))
    hits = bm25_search(queries.select("query_id", "query", (n > 0).alias("filtered")), index, boosts).join(chunks.select("chunk_id", "country_code"), "chunk_id")
    hits = hits.join(slots, "query_id").where("code is null or code = country_code")
    w = Window.partitionBy("query_id", "group_idx").orderBy(F.desc("score"), "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where("rank <= share")
    return interleave(ranked, F.col("max_sources"))


def apply_ranking(hits: DataFrame, orders: DataFrame) -> DataFrame:
    """RNK13: ``orders(query_id, ranking)``, a JSON list: reorder by it if it is a permutation of 1..n, else keep the order."""
    n = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("_n"))
    p = F.from_json("ranking", "array<int>")
    good = orders.join(n, "query_id").withColumn("p", p).where((F.size("p") == F.col("_n")) & (F.array_sort("p") == F.sequence(F.lit(1), F.col("_n"))))
    places = good.select("query_id", F.posexplode("p").alias("_at", "rank"))
    return hits.join(places, ["query_id", "rank"], "left").withColumn("position", F.coalesce(F.col("_at") + 1, F.col("rank"))).drop("_at")


def source_budgets(n: Column, budget: Column, per_source: int = SOURCE_CHARS) -> Column:
    """Budgets of ``n`` sources in order: the first up to ``per_source``, later ones an even share of what is left; what is left falls by the budget, and nothing more at zero."""

    def step(acc: Column, i: Column) -> Column:
        left = acc["left"]
        even = F.greatest(F.lit(1), F.floor(left / (n - i + 1)).cast("int"))
        own = F.when(left <= 0, F.lit(None).cast("int")).when(i == 1, F.least(F.lit(per_source), left)).otherwise(F.least(F.lit(per_source), even))
        return F.struct((left - F.coalesce(own, F.lit(0))).alias("left"), F.when(own.isNotNull(), F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    start = F.struct(budget.cast("int").alias("left"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step)["out"]


def context_budget(hits: DataFrame, total: int = TOTAL_CHARS, per_source: int = SOURCE_CHARS) -> DataFrame:
    """RNK15: ``hits(query_id, rank, country_code, content)`` regrouped by country in first-appearance order, each cut to its budget."""
    per = hits.groupBy("query_id", "country_code").agg(F.count("*").cast("int").alias("n"), F.min("rank").alias("first"))
    q = Window.partitionBy("query_id")
    per = per.withColumns({"countries": F.count("*").over(q), "country_no": F.row_number().over(q.orderBy("first"))})
    share = F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("countries")).cast("int"))
    budgets = per.select("query_id", "country_code", "country_no", F.posexplode(source_budgets(F.col("n"), share, per_source)).alias("_i", "budget"))
    rows = hits.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "country_code").orderBy("rank")) - 1)
    cut = rows.join(budgets, (rows["query_id"] == budgets["query_id"]) & rows["country_code"].eqNullSafe(budgets["country_code"]) & (rows["_i"] == budgets["_i"])).select(rows["*"], "country_no", "budget")
    cut = cut.withColumn("position", F.row_number().over(q.orderBy("country_no", "rank")))
    return cut.withColumn("excerpt", X.truncate_at_paragraph(F.col("content"), F.col("budget"))).drop("_i", "content", "country_no")


def merge_codes(a: Column, b: Column, cap: int | None = None) -> Column:
    """SET5: an ordered union, cut to ``cap`` codes if that is given."""
    both = F.array_distinct(F.concat(a, b))
    return both if cap is None else F.slice(both, 1, cap)
