"""The queries of this subpackage, and the SQL that DuckDB can check them against."""

from __future__ import annotations

from episodica.llm.decontaminate import op4_bm25_leaks
from episodica.llm.html_text import op1_tree_model_text
from episodica.llm.licenses import op7_license_notices
from episodica.llm.packing import op6_minimum_bin_slack
from episodica.llm.phrases import OP11_SQL, op11_phrase_streams
from episodica.llm.pii import op5_bootstrapped_pii
from episodica.llm.quality import op3_repetition_rules
from episodica.llm.runs import op13_periodic_runs
from episodica.llm.simhash import op10_simhash_components
from episodica.llm.suffixes import op8_bucket_pointer_dedup
from episodica.llm.tokenfiles import op9_token_files
from episodica.llm.toxicity import op12_nnpu_toxicity
from episodica.llm.warc import OP2_SQL, op2_merkle_fixity

QUERIES = {
    f.__name__: f
    for f in (
        op1_tree_model_text,
        op2_merkle_fixity,
        op3_repetition_rules,
        op4_bm25_leaks,
        op5_bootstrapped_pii,
        op6_minimum_bin_slack,
        op7_license_notices,
        op8_bucket_pointer_dedup,
        op9_token_files,
        op10_simhash_components,
        op11_phrase_streams,
        op12_nnpu_toxicity,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {"op2_merkle_fixity": OP2_SQL, "op11_phrase_streams": OP11_SQL}
