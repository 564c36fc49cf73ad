"""Result tables as documents, and nearest vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

QUERIES_PER_BLOCK = 256
MOST_QUERIES = 100_000


def rows_to_documents(df: DataFrame, source: str, key: str, n: int | None = None) -> DataFrame:
    """Each row as text with the name of its table; all rows, or the first ``n`` by key."""
    rows = df if n is None else df.orderBy(key).limit(n)
    return rows.select(F.lit(source).alias("source"), F.col(key).alias("row_key"), F.to_json(F.struct(*df.columns)).alias("text"))


def tables_to_documents(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All rows of several result tables, each given with its key column, as documents."""
    parts = [rows_to_documents(df, source, key).withColumn("row_key", F.col("row_key").cast("string")) for source, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(id_col), v.alias("_v"), _norm(v).alias("_len")).where("_len > 0").select(
        id_col, F.transform("_v", lambda x: x / F.col("_len")).alias("_unit")
    )


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` corpus vectors with the largest cosine similarity to each query, exactly.

    The queries (one question, usually) are packed into blocks of a few hundred, and a corpus row meets one
    packed row per block. Every task keeps only its own best ``k`` per query before anything is shuffled. Every query is
    compared with the whole corpus, so more than MOST_QUERIES are refused. Vectors of length zero have no
    direction and take no part.
    """
    units = unit_vectors(queries, query_id, vector)
    asked = queries.count()
    if asked > MOST_QUERIES:
        raise ValueError(f"{asked} queries are too many to compare each with the whole corpus")
    blocks = max(1, math.ceil(asked / QUERIES_PER_BLOCK))
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    packed = units.groupBy(block.cast("int").alias("_block")).agg(F.collect_list(F.struct(query_id, F.col("_unit").alias("_q"))).alias("_queries"))
    rows = unit_vectors(corpus, vec_id, vector).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.join(packed, "_block").select(vec_id, "_unit", F.inline("_queries"))
    scored = met.select(query_id, vec_id, _dot(F.col("_unit"), F.col("_q")).alias("score"))
    # row_number() <= k lets Spark cut every task's rows down to k per query ahead of the exchange.
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), vec_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
