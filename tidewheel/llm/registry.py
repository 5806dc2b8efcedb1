"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontamination, hamming_search, language_model, licenses, mixing, ngram_join, secrets, sharding, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_token_counts": token_counts.query,
    "op3_decontamination": decontamination.query,
    "op4_hamming_search": hamming_search.query,
    "op5_licenses": licenses.query,
    "op6_language_model": language_model.query,
    "op7_mixing": mixing.query,
    "op8_secrets": secrets.query,
    "op9_ngram_join": ngram_join.query,
    "op10_sharding": sharding.query,
}
ORACLES = {"op10_sharding": sharding.ORACLE_SQL, "op4_hamming_search": hamming_search.ORACLE_SQL, "op9_ngram_join": ngram_join.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL}
