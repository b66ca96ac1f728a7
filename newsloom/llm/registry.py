"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from newsloom.llm import contamination, embedding_dedup, filter_audit, language_id, licenses, mixing, ngram_join, quality, secrets, sharding, url_filters, vector_codes, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_shards": sharding.op3_shards,
        "op4_url_filters": url_filters.op4_url_filters,
        "op5_secrets": secrets.op5_secrets,
        "op6_mixing": mixing.op6_mixing,
        "op7_warc": warc.op7_warc,
        "op8_contamination": contamination.op8_contamination,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_language": language_id.op10_language,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_licenses": licenses.op12_licenses,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op4_url_filters": url_filters.OP4_SQL,
        "op7_warc": warc.OP7_SQL,
        "op8_contamination": contamination.OP8_SQL,
        "op9_embedding_dedup": embedding_dedup.OP9_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
