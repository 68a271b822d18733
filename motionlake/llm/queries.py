"""The registered training-data queries and the SQL for those that SQL can state."""

from __future__ import annotations

from . import bpe, centroids, chat, exact_dedup, langid, mainblocks, media, minhash, mixing, ppm, substring_dedup, toxicity, trie

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_minhash": minhash.op2_minhash,
    "op3_media": media.op3_media,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat": chat.op6_chat,
    "op7_entropy_mix": mixing.op7_entropy_mix,
    "op8_ppm": ppm.op8_ppm,
    "op9_language": langid.op9_language,
    "op10_bpe": bpe.op10_bpe,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_centroids": centroids.op12_centroids,
    "op13_main_text": mainblocks.op13_main_text,
    "media_digests": media.media_digests,
    "media_pages": media.media_pages,
    "mix_targets": mixing.mix_targets,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_minhash": minhash.OP2_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_chat": chat.OP6_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "media_digests": media.MEDIA_DIGESTS_SQL,
    "mix_targets": mixing.MIX_TARGETS_SQL,
}
