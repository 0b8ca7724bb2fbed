"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, decontaminate, dualtree, fingerprints, html, jaccard, language, licenses, lines, mixing, ngram_lm, onebit, quality, twins


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_benchmark_leaks": decontaminate.op3_benchmark_leaks,
        "op4_lm_scores": ngram_lm.op4_lm_scores,
        "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
        "op5_link_counts": jaccard.op5_link_counts,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_language_id": language.op7_language_id,
        "op8_html_extraction": html.op8_html_extraction,
        "op9_source_mixing": mixing.op9_source_mixing,
        "op10_quality": quality.op10_quality,
        "op11_nearest_neighbours": onebit.op11_nearest_neighbours,
        "op12_centroid_clustering": dualtree.op12_centroid_clustering,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.OP2_SQL,
        "op5_ngram_jaccard": jaccard.OP5_SQL,
        "op5_link_counts": jaccard.OP5_LINKS_SQL,
        "op6_line_dedup": twins.OP6_SQL,
        "op7_language_id": twins.OP7_SQL,
        "op9_source_mixing": twins.OP9_SQL,
        "op11_nearest_neighbours": onebit.OP11_SQL,
        "op12_centroid_clustering": dualtree.OP12_SQL,
    }
