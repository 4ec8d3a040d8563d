"""The queries of the corpus operators and the SQL that some are checked against."""

from corvane.llm.bpe import op4_bpe
from corvane.llm.html import op6_html
from corvane.llm.langid import op2_language_id
from corvane.llm.mixing import SQL as MIXING_SQL
from corvane.llm.mixing import op7_mixing
from corvane.llm.passages import op10_passages
from corvane.llm.quality import op1_quality
from corvane.llm.rules import SQL as RULES_SQL
from corvane.llm.rules import op3_quality_rules
from corvane.llm.simhash import op9_simhash
from corvane.llm.token_files import op8_token_files
from corvane.llm.topk import SQL as TOPK_SQL
from corvane.llm.topk import op5_topk

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_topk": op5_topk,
    "op6_html": op6_html,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_simhash": op9_simhash,
    "op10_passages": op10_passages,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": RULES_SQL,
    "op5_topk": TOPK_SQL,
    "op7_mixing": MIXING_SQL,
}
