"""Registered queries of the operators (one ``opN_<name>`` each), the pipeline, and their production parameters."""

from __future__ import annotations

from inkmeter.llm import decontam, extract, language, minhash, mixing, search, simhash_pivots, sketch, spelling, suffix_dedup, token_store, toxicity, warc
from inkmeter.llm.common import table
from inkmeter.llm.oracle_sql import SQL  # noqa: F401  (read by the driver's contract)


def op5_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


#: Times the most repeated source of a mixture may be read.
MAX_EPOCHS = 1.5


def op1_simhash_pivots(spark, sf_dir):
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers (the same path on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_store(spark, sf_dir):
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"), max_epochs=MAX_EPOCHS)


def op4_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_main_text(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark, sf_dir):
    return sketch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    out = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("distance")  # the Hamming distance of the fingerprints is no part of the result


def op9_warc(spark, sf_dir):
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("file")


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


Q = {f.__name__: f for f in (
    op1_simhash_pivots, op2_token_store, op3_mixing, op4_toxicity, op5_language_id, op6_main_text, op7_fingerprints, op8_decontamination, op9_warc, op10_suffix_dedup,
    op11_spelling_variants, op12_minhash, op13_lexical_search,
)}
