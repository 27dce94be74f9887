"""The queries of this subpackage, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from mnemoria.llm.collocations import OP12_SQL, op12_collocations
from mnemoria.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from mnemoria.llm.filter_audit import OP11_SQL, op11_filter_audit
from mnemoria.llm.language_id import op10_language_id
from mnemoria.llm.line_dedup import op4_line_dedup
from mnemoria.llm.mixing import op6_source_mixing
from mnemoria.llm.packing import op8_packing
from mnemoria.llm.quality import OP7_SQL, op7_quality_rules
from mnemoria.llm.secret_scan import op5_secret_scan
from mnemoria.llm.setsketch import OP13_SQL, op13_setsketch
from mnemoria.llm.simhash import op1_simhash
from mnemoria.llm.token_counts import op2_token_counts
from mnemoria.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_setsketch": op13_setsketch,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op7_quality_rules": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_setsketch": OP13_SQL,
}
