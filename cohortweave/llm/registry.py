"""The queries of this package and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortweave.llm.additive_quality import op2_additive_quality
from cohortweave.llm.backoff_scoring import op4_backoff_scoring
from cohortweave.llm.license_scan import op1_license_scan
from cohortweave.llm.ngram_join import OP9_SQL, op9_ngram_jaccard
from cohortweave.llm.one_permutation import op6_one_permutation
from cohortweave.llm.packing import op5_harmonic_packing
from cohortweave.llm.periodic_runs import op13_periodic_runs
from cohortweave.llm.phrase_mining import OP12_SQL, op12_phrase_mining
from cohortweave.llm.quality_rules import op8_quality_rules
from cohortweave.llm.secrets_scan import op7_secret_scan
from cohortweave.llm.soft_mixing import op10_soft_mixing
from cohortweave.llm.suffix_dedup import op11_suffix_dedup
from cohortweave.llm.token_files import op3_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_additive_quality": op2_additive_quality,
    "op3_token_files": op3_token_files,
    "op4_backoff_scoring": op4_backoff_scoring,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_one_permutation": op6_one_permutation,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_soft_mixing": op10_soft_mixing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op9_ngram_jaccard": OP9_SQL,
    "op12_phrase_mining": OP12_SQL,
}
