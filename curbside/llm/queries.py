"""The registered queries of the text operators, with their SQL."""

from __future__ import annotations

from curbside.llm import automaton_dedup, bwt_dedup, digest_index, filter_audit, graph_index, mixing, near_dedup, quality, sharded_lloyd, sp_tokenizers, token_store, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": bwt_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_substring_dedup": automaton_dedup.op4_substring_dedup,
    "op5_warc": warc.op5_warc,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_exact_dedup": digest_index.op7_exact_dedup,
    "op8_token_store": token_store.op8_token_store,
    "op9_sentencepiece": sp_tokenizers.op9_sentencepiece,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_graph_index": graph_index.op11_graph_index,
    "op12_sharded_lloyd": sharded_lloyd.op12_sharded_lloyd,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op1_suffix_dedup": bwt_dedup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_quality": quality.OP3_SQL,
    "op4_substring_dedup": automaton_dedup.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_exact_dedup": digest_index.OP7_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_graph_index": graph_index.OP11_SQL,
    "op12_sharded_lloyd": sharded_lloyd.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
