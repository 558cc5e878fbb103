"""Registered queries of this subpackage and their SQL twins."""
from __future__ import annotations

from sparkraster.llm import decontaminate, html_text, line_dedup, mixing, near_dedup, neighbours, prefix_trie, pseudonyms, simhash, spelling, toxicity, url_filter, warc

QUERIES = {f.__name__: f for f in (line_dedup.op1_line_dedup, html_text.op2_html_extract, pseudonyms.op3_pseudonyms, url_filter.op4_url_filter, mixing.op5_mix_sources, near_dedup.op6_near_dedup, toxicity.op7_toxicity, neighbours.op8_neighbours, decontaminate.op9_decontaminate, warc.op10_warc_normalise, spelling.op11_spelling_variants, prefix_trie.op12_prefix_trie, simhash.op13_simhash_dedup)}
ORACLES = {"op10_warc_normalise": warc.OP10_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
