"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.tables import table

from . import documented, neighbours, origin, packing, sentences, splitting, syntax, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.not_by_hand(table(spark, d, "hier_files"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files not written by hand per reason; a file may have several."""
    return origin.origins(table(spark, d, "hier_files")).groupBy("reason").agg(F.count("*").alias("n_files"))


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """The globs that mark files, declared and mined."""
    return origin.rules_of(table(spark, d, "hier_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "hier_files")).select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per project and language, beside what earlier reports said."""
    return syntax.rates(table(spark, d, "hier_files"), table(spark, d, "parse_errors"))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "size_limits")
    return splitting.items(
        [
            ("hier_files", table(spark, d, "hier_files"), "file_id", "content", splitting.limits(limits, "hier_files.content")),
            ("semantic_embeddings", table(spark, d, "semantic_embeddings"), "embedding_id", "context", splitting.limits(limits, "semantic_embeddings.context")),
        ]
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that the splitting cuts."""
    return _oversized(spark, d).where(F.size("bodies") > 1).select("item_table", "item_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_oversized(spark, d)).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "semantic_embeddings"))


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all rows for each row whose id is divisible by 20, by walking the graph."""
    e = table(spark, d, "semantic_embeddings")
    return neighbours.searched(e, e.where("embedding_id % 20 = 0"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented_functions(table(spark, d, "hier_files"), with_text=False)


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documentation and code of every pair."""
    return documented.documented_functions(table(spark, d, "hier_files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of the documents' texts."""
    limit = table(spark, d, "size_limits").where("item_field = 'documents.text' AND unit = 'tokens'").select("max_size").first()
    sizes = tokens.encode(table(spark, d, "documents"), "doc_id", "text", counts_only=True)
    if limit is None:  # nothing says how much a container holds
        return packing.pack(sizes.limit(0), 1)
    return packing.pack(sizes, int(limit[0]))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"))


def queries():
    return {
        f.__name__: f
        for f in (p1_found, p1_reasons, p1_rules, p3_found, p3_rates, p4_found, p4_pieces, p5_found, p5_search, p7_found, p7_pairs, p8_ids, p9_containers, p10_found)
    }


def oracle_sql():
    return {
        "p4_found": """
SELECT DISTINCT 'hier_files' AS item_table, file_id AS item_id FROM hier_files
WHERE length(content) > (SELECT max_size FROM size_limits WHERE item_field = 'hier_files.content')
UNION ALL
SELECT DISTINCT 'semantic_embeddings', embedding_id FROM semantic_embeddings
WHERE length(context) > (SELECT max_size FROM size_limits WHERE item_field = 'semantic_embeddings.context')""",
    }
