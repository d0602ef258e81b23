"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, collocations, decontaminate, html_main, importance, katz, langid, licenses, line_dedup, near_dedup, piece_sampling, secrets, token_files

QUERIES = {f.__name__: f for f in (decontaminate.op1_decontamination, html_main.op2_html_extraction, piece_sampling.op3_sentencepiece, near_dedup.op4_near_dedup, langid.op5_language_id, licenses.op6_license_scan, line_dedup.op7_line_dedup, ann.op8_nearest_neighbours, katz.op9_lm_scoring, secrets.op10_secret_scan, importance.op11_importance_resampling, token_files.op12_token_files, collocations.op13_phrase_mining)}
ORACLES = {"op6_license_scan": licenses.oracle(), "op7_line_dedup": line_dedup.ORACLE, "op11_importance_resampling": importance.oracle(), "op13_phrase_mining": collocations.ORACLE}
