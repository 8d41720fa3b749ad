"""The registered queries of the training-data operators and their DuckDB counterparts."""

from labourmill.llm import centroids, chat, classifier, codes, jaccard, mixing, packing, pii, quality, secret_scan, sharding, simhash, substring

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_pii": pii.op2_pii,
    "op3_simhash": simhash.op3_simhash,
    "simhash_neighbours": simhash.simhash_neighbours,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_substring": substring.op7_substring,
    "op8_classifier": classifier.op8_classifier,
    "op9_preferences": chat.op9_preferences,
    "lent_answers": chat.lent_answers,
    "op10_mixing": mixing.op10_mixing,
    "op11_centroids": centroids.op11_centroids,
    "op12_secrets": secret_scan.op12_secrets,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLES = {
    "op1_sharding": sharding.ORACLE,
    "op4_jaccard": jaccard.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_substring": substring.ORACLE,
    "op9_preferences": chat.ORACLE,
    "lent_answers": chat.LENT_ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
