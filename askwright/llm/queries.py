"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from askwright.llm import bpe, chat_format, decontamination, exact_dedup, filter_audit, language_id, licenses, quality_rules, secrets, simhash, source_audit, suffix_dedup, toxicity
from askwright.llm.common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark, sf_dir):
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op3_language_id(spark, sf_dir):
    return language_id.learn_and_identify(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_bpe(spark, sf_dir):
    path = ranks_path()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def op6_secrets(spark, sf_dir):
    return secrets.report(secrets.scan_documents(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_format(spark, sf_dir):
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.prefix_target_examples(rows))


def op11_quality_rules(spark, sf_dir):
    return quality_rules.report(quality_rules.judge(table(spark, sf_dir, "documents")))


def op12_source_audit(spark, sf_dir):
    return source_audit.divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_secrets": op6_secrets,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_quality_rules": op11_quality_rules,
    "op12_source_audit": op12_source_audit,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op12_source_audit": source_audit.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
