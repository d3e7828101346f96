"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import jaccard_join, language, ppm, quality, toxicity
from gridlake.llm.common import read, remainder
from gridlake.llm.conversation_repair import damage, repair
from gridlake.llm.decontamination import find_contamination, is_contaminated, n_hit
from gridlake.llm.mixing import plan_mix
from gridlake.llm.ranked_search import search
from gridlake.llm.simhash import near_duplicates
from gridlake.llm.token_files import encode_documents
from gridlake.llm.tool_calls import link_calls
from gridlake.llm.weighted_sampling import compare_edited


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 5, 2, 1 takes of each document."""
    return plan_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document, learned from four fifths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ppm.score(docs, remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), *scored.columns[1:])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from two thirds of the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.with_score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from two thirds of the documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, remainder("doc_id", 3) != 1)
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "lang_pred",
        "score",
        "ambiguous",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of each document inside windows of 13 words of a benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit("spans").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        is_contaminated("n_words", "spans").alias("contaminated"),
    )


# The tools that assistants' turns stand for, in turn, and what their arguments must be.
_TEXT = {"type": "string", "minLength": 1, "maxLength": 1000}
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": _TEXT, "size": {"type": "integer", "maximum": 800}}},
    "write": {"type": "object", "required": ["query", "size"], "properties": {"size": {"type": "integer", "minimum": 200}}},
    "translate": {"type": "object", "required": ["query", "target"], "properties": {"query": _TEXT}},
}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, validated and written as JSON.

    The tables hold no calls, so turns stand for them: an assistant's turn is a call with its text as
    argument, which comes after the call two turns before, and the user's next turn is its result.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    turn = F.col("turn")
    calls = turns.where("role = 'assistant'").select(
        "conv_id",
        name(turn).alias("call_id"),
        "turn",
        F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (turn % len(TOOLS)).cast("int") + 1).alias("tool"),
        F.to_json(F.struct(F.char_length("text").alias("size"), F.col("text").alias("query"))).alias("arguments"),
        F.array(name(turn - 2)).alias("after"),
    )
    results = turns.where("role = 'user'").select(
        "conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("result")
    )
    linked = link_calls(calls, results, TOOLS)
    return linked.withColumn("problems", F.array_join("problems", "; "))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of each document in token files, read back from them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and their components at 4 bits or fewer."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from four fifths of the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.with_score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of an edited one, and how alike they and the next one are."""
    return compare_edited(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of each conversation, after planted damage."""
    return repair(damage(read(spark, sf_dir, "conversations")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_tool_calls": op2_tool_calls,
    "op3_token_files": op3_token_files,
    "op4_ppm": op4_ppm,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_weighted_sampling": op10_weighted_sampling,
    "op11_repair": op11_repair,
    "op12_search": op12_search,
    "op13_jaccard": op13_jaccard,
}
