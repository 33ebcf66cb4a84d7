"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tallyvane.llm import audio, collocation, jaccard, lines, mixing, packing, pii, scoring, sharding, substring, topk, toxicity, trie

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_topk": topk.op4_topk,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_scoring": scoring.op6_scoring,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring": substring.op8_substring,
    "op9_audio": audio.op9_audio,
    "op10_sharding": sharding.op10_sharding,
    "op11_collocation": collocation.op11_collocation,
    "op12_lines": lines.op12_lines,
    "op13_trie": trie.op13_trie,
}
ORACLE_SQL = {"op4_topk": topk.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op11_collocation": collocation.ORACLE_SQL, "op12_lines": lines.ORACLE_SQL, "op13_trie": trie.ORACLE_SQL}
