"""The ``pN_`` queries: each runs its problem's operator, with production parameters, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carda.session import cut, sized_broadcast, table, wide_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.pii import find_items, listing_texts

    return find_items(listing_texts(wide_table(spark, d, "jobs_clean"), wide_table(spark, d, "posts"))).select("src_table", "row_id", "pii_type", "start_pos")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.pii import listing_texts, mask_text

    return mask_text(listing_texts(wide_table(spark, d, "jobs_clean"), wide_table(spark, d, "posts"))).select("src_table", "row_id", "masked")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.survivor import surviving_fields

    return surviving_fields(table(spark, d, "jobs_clean"), table(spark, d, "review_queue"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.survivor import surviving_bundles

    return surviving_bundles(table(spark, d, "jobs_clean"), table(spark, d, "review_queue"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.canonical import map_jobs, typed_differently

    regions, categories = table(spark, d, "regions"), table(spark, d, "categories")
    return typed_differently(map_jobs(table(spark, d, "jobs_clean"), regions, categories), regions, categories)


def _judged_values(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.truncation import judge_truncation, listing_values

    return judge_truncation(listing_values(table(spark, d, "jobs_clean"), table(spark, d, "posts")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged_values(spark, d).where("cut").select("src_table", "row_id")


def p4_source_rates(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.truncation import truncation_rates

    return truncation_rates(_judged_values(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.blocks import main_blocks
    from carda.llm.mojibake import find_garbled, listing_texts

    pages = wide_table(spark, d, "raw_pages").where("http_status = 200").select("id", "raw_html")
    garbled = cut(find_garbled(listing_texts(wide_table(spark, d, "raw_pages"), None)).select(F.col("row_id").alias("page_id")))
    # pages are labelled where they lie; only their blocks, a hundredth of the markup, meet the garbled pages
    blocks = main_blocks(pages, once=True).select("page_id", "block_md5").distinct()
    return blocks.join(sized_broadcast(garbled, garbled.count()), "page_id", "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.history import repeats

    return repeats(table(spark, d, "jobs_clean"), table(spark, d, "regions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.mojibake import find_garbled, listing_texts

    return find_garbled(listing_texts(wide_table(spark, d, "raw_pages"), wide_table(spark, d, "jobs_clean"))).select("src_table", "row_id")


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.mojibake import find_garbled, listing_texts

    return find_garbled(listing_texts(wide_table(spark, d, "raw_pages"), wide_table(spark, d, "jobs_clean"))).select("src_table", "row_id", "chain", "restored")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.leakage import leaked_items

    return leaked_items(wide_table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.mixing import mix

    return mix(wide_table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.mixing import actual_shares, mix

    targets = table(spark, d, "mix_targets")
    return actual_shares(mix(wide_table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.lookalike import same_to_the_eye

    return same_to_the_eye(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    from carda.llm.lookalike import variant_classes

    return variant_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_masked": p1_masked,
        "p2_found": p2_found,
        "p2_records": p2_records,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_source_rates": p4_source_rates,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_repaired": p7_repaired,
        "p8_found": p8_found,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_classes": p10_classes,
    }


def oracle_sql() -> dict[str, str]:
    return {}
