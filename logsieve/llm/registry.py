"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from logsieve.llm.bpe import op4_bpe
from logsieve.llm.chat_format import op13_chat_format
from logsieve.llm.html_extract import op2_html_extract
from logsieve.llm.kneser_ney import op10_quality_lm
from logsieve.llm.nearest import op3_nearest
from logsieve.llm.oracles import ORACLES
from logsieve.llm.packing import op5_packing
from logsieve.llm.prefix_trie import op12_prefix_trie
from logsieve.llm.repetition import op7_quality_rules
from logsieve.llm.secrets_scan import op8_secret_scan
from logsieve.llm.simhash import op1_simhash
from logsieve.llm.suffix_dedup import op9_suffix_dedup
from logsieve.llm.toxicity import op6_toxicity
from logsieve.llm.whitening import op11_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_extract": op2_html_extract,
    "op3_nearest": op3_nearest,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_lm": op10_quality_lm,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}

__all__ = ["ORACLES", "QUERIES"]
