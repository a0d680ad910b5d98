"""The corpus operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import byte_bpe, iso_media, label_shards, line_crf, line_suffixes, minhash_forest, mixing, spherical_caps, string_kernel, token_planes

QUERIES = {
    "op1_token_planes": token_planes.op1_token_planes,
    "op2_label_shards": label_shards.op2_label_shards,
    "op3_minhash_forest": minhash_forest.op3_minhash_forest,
    "op4_iso_media": iso_media.op4_iso_media,
    "op5_line_crf": line_crf.op5_line_crf,
    "op6_line_suffixes": line_suffixes.op6_line_suffixes,
    "op7_spherical_caps": spherical_caps.op7_spherical_caps,
    "op8_pair_index_bpe": byte_bpe.op8_pair_index_bpe,
    "op9_budget_tree": mixing.op9_budget_tree,
    "op10_string_kernel": string_kernel.op10_string_kernel,
}

ORACLES: dict[str, str] = {
    "op3_minhash_forest": minhash_forest.OP3_SQL,
    "op6_line_suffixes": line_suffixes.OP6_SQL,
    "op7_spherical_caps": spherical_caps.OP7_SQL,
    "op9_budget_tree": mixing.OP9_SQL,
}
