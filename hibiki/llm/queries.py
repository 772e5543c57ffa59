"""The queries of the operators of this folder, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import abuse, dup_format, leaks, lookalike, mixing, packing, qa_defects, sentences, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = None
    for name in ("semantic_challenge_v2_chunks", "smoke_v2_chunks"):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("src_table"), "row_no", "text")
        both = rows if both is None else both.unionByName(rows)
    return sentences.sentence_units(both, "text", ["src_table", "row_no"]).drop("unit_no")  # row_no is unique: so are the units


def p1_document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_defects.qa_defects(table(spark, sf_dir, "approved_qa_alias_fixture"), "qa_id", "question", "approved_answer")


def p2_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("defect_type").agg(F.count("*").alias("n_pairs"))


def evaluation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "semantic_challenge_v2_cases").select(F.lit("semantic_challenge_v2_cases").alias("item_table"), F.col("case_id").alias("item_id"), F.col("query").alias("item_text"))
    answers = table(spark, sf_dir, "approved_qa_alias_fixture").select(F.lit("approved_qa_alias_fixture").alias("item_table"), F.col("qa_id").alias("item_id"), "question", "approved_aliases")
    texts = F.concat(F.array("question"), F.coalesce("approved_aliases", F.array().cast("array<string>")))
    return cases.unionByName(answers.select("item_table", "item_id", F.explode(texts).alias("item_text"))).filter("item_text is not null and item_id is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", evaluation_items(spark, sf_dir))


def p4_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("item_table", "item_id").agg(F.count("*").alias("n_docs"))


def _looked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("semantic_challenge_v2_cases", "query"), ("semantic_challenge_v2_chunks", "text"), ("manufacturing_chunks", "normalized_question"))
    out = None
    for name, field in fields:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("src_table"), "row_no", F.col(field).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(_looked_at(spark, sf_dir), ["src_table"], "row_no", "value")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the one form of its value."""
    rows = lookalike.keyed(_looked_at(spark, sf_dir), "value")
    return rows.join(lookalike.one_form(rows, "value"), ["k0", "k1"]).select("src_table", "row_no", "form")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, question in (("manufacturing_chunks", "normalized_question"), ("approved_qa_alias_fixture", "question")):
        rows = table(spark, sf_dir, name)
        rows = rows.filter(F.col(question).isNotNull()) if name == "manufacturing_chunks" else rows
        parts.append(rows.select(F.lit(name).alias("src_table"), "row_no", F.create_map(F.lit("tenant_id"), F.col("tenant_id"), F.lit("question"), F.col(question)).alias("fields")))
    sent = table(spark, sf_dir, "approved_qa_submissions").select(F.lit("approved_qa_submissions").alias("src_table"), F.col("submission_id").alias("row_no"), dup_format.payload_fields(F.col("payload")).alias("fields"))
    return dup_format.copies(parts[0].unionByName(parts[1]).unionByName(sent), "src_table", "row_no", "fields")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).filter("key <> first").select("src_table", F.col("first").alias("row_a"), F.col("key").alias("row_b")).distinct()


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return _copies(spark, sf_dir).groupBy("src_table", F.col("first").alias("row_no")).agg(F.countDistinct("key").alias("n_copies"))


def _parameters(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a table of parameters.  It goes to the driver, so more rows than *most* are an error; none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of parameters")
    return rows


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    targets = [(r["pack_id"], r["capacity_tokens"]) for r in _parameters(table(spark, sf_dir, "pack_targets").select("pack_id", "capacity_tokens"))]
    return packing.pack(sizes, targets)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each target are."""
    boxes = p7_containers(spark, sf_dir).groupBy("pack_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("fill_tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return boxes.select("*", least.alias("least_containers"), (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled_share"))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    return [(r["source"], r["target_share"], r["max_repeats"]) for r in _parameters(table(spark, sf_dir, "mix_targets"))]


def p8_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.mix(sizes, _targets(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.shares(mixing.mix(sizes, _targets(spark, sf_dir)), sizes, table(spark, sf_dir, "mix_targets"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "document_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).filter("score >= 0.5").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_rates(_scores(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_document_sentences, p2_found, p2_defect_counts, p4_found, p4_leaked_items, p5_found, p5_forms, p6_found, p6_records, p7_containers, p7_fill, p8_draw, p8_shares, p9_found, p9_scores, p9_rates)}
