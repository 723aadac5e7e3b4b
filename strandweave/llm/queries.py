"""The pN_ queries of the operators on texts, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import stores, table
from .abuse import fit_context, rates, score_fields
from .bpe_ids import encode_corpus
from .languages import fit_language_net, language_segments, saved_net, unnamed_languages
from .leaks import find_leaks
from .personal import personal_kinds, redacted
from .residue import find_residue
from .same_form import consistent_form, find_copies


def _context(spark: SparkSession, d: str, most: int = 20_000) -> tuple[float, ...]:
    """Weights of the signs around a window, from at most ``most`` reviewed texts."""
    rows = table(spark, d, "review_labels").where("text is not null AND label is not null").select("text", "label").limit(most).collect()
    return fit_context(sorted((r[0], r[1]) for r in rows))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return score_fields(table(spark, d, "actions"), "ingest_seq", ["action_text", "target"], only_found=True, weights=_context(spark, d)).select("ingest_seq", "field")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_fields(table(spark, d, "actions"), "ingest_seq", ["action_text", "target"], weights=_context(spark, d))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(table(spark, d, "actions"), "ingest_seq", ["action_text", "target"], "feed", weights=_context(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return find_copies(table(spark, d, "actions"), "ingest_seq", ["action_text", "target"], table(spark, d, "pinned_posts"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent_form(table(spark, d, "actions").select("ingest_seq", "action_text", "target"), ["action_text", "target"]).select("ingest_seq", "action_text_form", "target_form")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=False)
    return found.where("leaked AND longest_run >= 15").select("doc_id", "item_id")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_kinds(spark, d).select("doc_id").distinct()


def _language_net(spark: SparkSession, d: str):
    """The network of these tables; fitted once for their files and kept in the shared folder."""
    tables = [table(spark, d, n) for n in ("actions", "eval_items", "pinned_posts")]
    files = sorted(f for t in tables for f in t.inputFiles())
    written = [stores.modified(spark, f"{d}/{n}.parquet") for n in ("actions", "eval_items", "pinned_posts")]
    named = hashlib.sha256("\n".join([*files, *map(str, written)]).encode()).hexdigest()[:24]
    clean = [tables[1].select("item_text", "lang"), tables[2].select("post_text", "lang")]
    fit = lambda: fit_language_net(tables[0], clean, key="ingest_seq", text="action_text", lang="lang")
    return saved_net(spark, f"{ensure_checkpoint_dir(spark)}/language-net-{named}", fit)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unnamed_languages(table(spark, d, "actions"), "ingest_seq", "action_text", "lang", _language_net(spark, d))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(table(spark, d, "actions"), "ingest_seq", "action_text", _language_net(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    posts = personal_kinds(table(spark, d, "actions"), "actions", F.col("ingest_seq").cast("string"), "action_text")
    key = F.concat_ws(":", F.col("community_id").cast("string"), F.col("user_id").cast("string"))
    return posts.unionByName(personal_kinds(table(spark, d, "user_profile_cache"), "user_profile_cache", key, "profile_text"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "actions").select(F.lit("actions").alias("src"), F.col("ingest_seq").cast("string").alias("rec_key"), F.col("action_text").alias("text"))
    key = F.concat_ws(":", F.col("community_id").cast("string"), F.col("user_id").cast("string"))
    bios = table(spark, d, "user_profile_cache").select(F.lit("user_profile_cache").alias("src"), key.alias("rec_key"), F.col("profile_text").alias("text"))
    return redacted(posts.unionByName(bios), "text").select("src", "rec_key", "text_redacted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_alignments": p9_alignments,
    "p10_found": p10_found,
    "p10_kinds": p10_kinds,
}

SQL: dict[str, str] = {}
