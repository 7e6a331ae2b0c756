"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from tessera.llm import bpe, chat, codes, lines, lm, minhash, mixing, pages, quality, repair, suffix, token_counts, topk

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        chat.op2_prefix_targets,
        topk.op3_exact_top_k,
        quality.op4_quality_rules,
        suffix.op5_suffix_array_dedup,
        lines.op6_line_dedup,
        lm.op7_bloom_lm_scores,
        bpe.op8_bpe_encode_decode,
        mixing.op9_poisson_mixing,
        minhash.op10_minhash_near_dedup,
        repair.op11_tight_arc_repair,
        codes.op12_elkan_codes,
        pages.op13_line_block_text,
    )
}
SQL = {
    "op2_prefix_targets": chat.SQL,
    "op3_exact_top_k": topk.SQL,
    "op4_quality_rules": quality.SQL,
    "op6_line_dedup": lines.SQL,
    "op9_poisson_mixing": mixing.SQL,
    "op10_minhash_near_dedup": minhash.SQL,
    "op11_tight_arc_repair": repair.SQL,
    "op12_elkan_codes": codes.SQL,
    "op13_line_block_text": pages.SQL,
}
