"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from carecolumns.llm import bpe, hard_negatives, html_text, lattice_lm, lexical_packing, licenses, mixing, ngram_jaccard, parsing_fingerprint, permutation_index, quality, secrets, source_divergence
from carecolumns.llm.common import table


def tokenizer(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_lattice_lm(spark, sf_dir):
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_secret_scan(spark, sf_dir):
    found = secrets.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score")


def op4_permutation_index(spark, sf_dir):
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.link_components(table(spark, sf_dir, "documents"))


def op6_parsing_fingerprint(spark, sf_dir):
    return parsing_fingerprint.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark, sf_dir):
    mix = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_bpe(spark, sf_dir):
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ids=False)


def op9_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_lexical_packing(spark, sf_dir):
    return lexical_packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_lattice_lm, op3_secret_scan, op4_permutation_index, op5_ngram_jaccard, op6_parsing_fingerprint, op7_pareto_mixing, op8_bpe, op9_quality, op10_license_scan, op11_source_divergence, op12_lexical_packing, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {"op5_ngram_jaccard": ngram_jaccard.SQL, "op7_pareto_mixing": mixing.SQL, "op10_license_scan": licenses.sql(), "op11_source_divergence": source_divergence.sql(), "op13_hard_negatives": hard_negatives.SQL}
