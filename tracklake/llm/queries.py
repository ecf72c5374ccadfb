"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tracklake.llm import alignment, best_fit_packing, embedding_dedup, exact_dedup, minhash_dedup, mixing, packing, pii, source_divergence, substring_dedup, token_files, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pfair_mix": mixing.op2_pfair_mix,
    "op3_pii": pii.op3_pii,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_embeddings": embedding_dedup.op5_embeddings,
    "op6_pack": packing.op6_pack,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_minhash": minhash_dedup.op8_minhash,
    "op9_warc_audit": warc.op9_warc_audit,
    "op10_token_files": token_files.op10_token_files,
    "op11_align": alignment.op11_align,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_best_fit_pack": best_fit_packing.op13_best_fit_pack,
}

SQL = {
    "op2_pfair_mix": mixing.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_warc_audit": warc.SQL,
    "op12_source_divergence": source_divergence.SQL,
}
