"""The queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from tablelens.llm import (
    bpe, collocations, decontaminate, html_text, language, lexical_search, linededup, pii, quality_model, quality_rules, secrets, simhash, toxicity,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_pii": pii.query,
    "op3_language": language.query,
    "op4_line_dedup": linededup.query,
    "op5_simhash": simhash.query,
    "op6_quality_model": quality_model.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_bpe": bpe.query,
    "op10_html_text": html_text.query,
    "op11_collocations": collocations.query,
    "op12_lexical_search": lexical_search.query,
    "op13_secrets": secrets.query,
}

ORACLES = {
    "op1_quality_rules": quality_rules.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
    "op11_collocations": collocations.oracle(),
    "op12_lexical_search": lexical_search.oracle(),
    "op13_secrets": secrets.oracle(),
}
