"""The registered queries of this subpackage, and their SQL where it can say them."""

from nearmark.llm import centroids, crossent, fingerprint, language, lexical, mixing, neardup, packing, pii, secretscan, tokencount, vectors, warc

QUERIES = {
    "op1_fingerprints": fingerprint.fingerprint_report,
    "op2_language": language.language_report,
    "op3_warc": warc.archive_report,
    "op4_crossent": crossent.score_report,
    "op5_tokencount": tokencount.token_report,
    "op6_neardup": neardup.near_duplicate_report,
    "op7_mixing": mixing.mix_report,
    "op8_vectors": vectors.vector_report,
    "op9_secrets": secretscan.secret_report,
    "op10_packing": packing.packing_report,
    "op11_ranked": lexical.ranked_report,
    "op12_personal": pii.personal_report,
    "op13_clusters": centroids.cluster_report,
}

ORACLES = {
    "op3_warc": warc.ARCHIVE_SQL,
    "op6_neardup": neardup.NEAR_SQL,
    "op7_mixing": mixing.MIX_SQL,
    "op8_vectors": vectors.VECTOR_SQL,
    "op11_ranked": lexical.RANKED_SQL,
    "op13_clusters": centroids.CLUSTER_SQL,
}
