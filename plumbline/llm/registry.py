"""The queries of this subpackage and their SQL."""

from . import chained_seeds, chat_trees, conversation_repair, decontaminate, fertility, katz, piece_bpe, rank_profiles, substring_ranks, token_counts, url_rules, vector_codes, weighted_minhash

QUERIES = {
    "op1_chat_formatting": chat_trees.op1_chat_formatting,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_chained_seeds": chained_seeds.op3_chained_seeds,
    "op4_fertility": fertility.op4_fertility,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_repeated_substrings": substring_ranks.op6_repeated_substrings,
    "op7_piece_bpe": piece_bpe.op7_piece_bpe,
    "op8_weighted_minhash": weighted_minhash.op8_weighted_minhash,
    "op9_katz": katz.op9_katz,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_rank_profiles": rank_profiles.op11_rank_profiles,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op1_chat_formatting": chat_trees.ORACLE,
    "op5_url_rules": url_rules.ORACLE,
    "op11_rank_profiles": rank_profiles.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
