"""The queries of this subpackage, by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from docspark.llm import op3_mixing as op3
from docspark.llm import op7_token_counts as op7
from docspark.llm import op8_exact_dedup as op8
from docspark.llm import op11_importance_resampling as op11
from docspark.llm.op1_quality_fm import op1_quality_fm
from docspark.llm.op2_line_dedup import op2_line_dedup
from docspark.llm.op4_quality_rules import op4_quality_rules
from docspark.llm.op5_ngram_join import op5_ngram_join
from docspark.llm.op6_language_crf import op6_language_crf
from docspark.llm.op9_license_scan import op9_license_scan
from docspark.llm.op10_bpe import op10_bpe
from docspark.llm.op12_duckdb_bpe import op12_duckdb_bpe
from docspark.llm.op13_periodic_runs import op13_periodic_runs

QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3.op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_language_crf": op6_language_crf,
    "op7_token_counts": op7.op7_token_counts,
    "op8_exact_dedup": op8.op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_bpe": op10_bpe,
    "op11_importance_resampling": op11.op11_importance_resampling,
    "op12_duckdb_bpe": op12_duckdb_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op3_mixing": op3.SQL, "op8_exact_dedup": op8.SQL, "op11_importance_resampling": op11.SQL}
