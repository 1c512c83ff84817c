"""Queries of the subpackage and their DuckDB answers, where SQL can express them."""

from __future__ import annotations

from specgate.llm import audio, blocks, caps, infill, minhash, mixing, packing, pieces, sharding, suffixes, token_files, toxicity, variants

QUERIES = {
    "op1_spherical_caps": caps.op1_spherical_caps,
    "op2_token_files": token_files.op2_token_files,
    "op3_best_fit": packing.op3_best_fit,
    "op4_chroma_fingerprints": audio.op4_chroma_fingerprints,
    "op5_block_labeller": blocks.op5_block_labeller,
    "op6_sparse_suffixes": suffixes.op6_sparse_suffixes,
    "op7_label_propagation": sharding.op7_label_propagation,
    "op8_inverted_join": minhash.op8_inverted_join,
    "op9_levenshtein": toxicity.op9_levenshtein,
    "op10_systematic_mix": mixing.op10_systematic_mix,
    "op11_piece_backtracking": pieces.op11_piece_backtracking,
    "op12_asymmetric_chunks": variants.op12_asymmetric_chunks,
    "op13_skip_list_infill": infill.op13_skip_list_infill,
}
ORACLES = {"op10_systematic_mix": mixing.SQL, "op12_asymmetric_chunks": variants.SQL, "op13_skip_list_infill": infill.SQL}
