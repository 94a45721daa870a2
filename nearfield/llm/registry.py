"""The queries of this package and their SQL, for the driver entry point."""

from __future__ import annotations

from nearfield.llm import bpe, chat, line_runs, mixing, pivots, quality_cnn, quality_rules, simhash, toxicity, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_robust_outliers": quality_rules.op2_robust_outliers,
    "op3_poisson_mix": mixing.op3_poisson_mix,
    "op4_simhash_pigeonring": simhash.op4_simhash_pigeonring,
    "op5_quality_cnn": quality_cnn.op5_quality_cnn,
    "op6_warc_index": warc.op6_warc_index,
    "op7_line_runs": line_runs.op7_line_runs,
    "op8_toxicity_gbt": toxicity.op8_toxicity_gbt,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_pivot_topk": pivots.op10_pivot_topk,
}
ORACLES: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_robust_outliers": quality_rules.OP2_SQL,
    "op3_poisson_mix": mixing.OP3_SQL,
    "op6_warc_index": warc.OP6_SQL,
    "op7_line_runs": line_runs.OP7_SQL,
    "op10_pivot_topk": pivots.OP10_SQL,
}
