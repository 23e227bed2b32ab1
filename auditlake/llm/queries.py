"""The registered queries of this folder and their SQL."""

from auditlake.llm import op1_pii, op10_lm, op11_divergence, op12_suffixes, op13_manifest, op2_substrings, op3_fingerprint, op4_bpe, op5_warc, op6_langid, op7_minhash, op8_mixing, op9_quality

QUERIES = {
    f.__name__: f
    for f in (op1_pii.op1_pii, op2_substrings.op2_substrings, op3_fingerprint.op3_fingerprint, op4_bpe.op4_bpe, op5_warc.op5_warc, op6_langid.op6_langid, op7_minhash.op7_minhash, op8_mixing.op8_mixing, op9_quality.op9_quality, op10_lm.op10_lm, op11_divergence.op11_divergence, op12_suffixes.op12_suffixes, op13_manifest.op13_manifest)
}

#: SQL has no seeded draws, trained models or tokenizers; those queries are tested against brute force instead.
ORACLE_SQL = {"op2_substrings": op2_substrings.ORACLE, "op5_warc": op5_warc.ORACLE, "op7_minhash": op7_minhash.ORACLE, "op9_quality": op9_quality.ORACLE, "op11_divergence": op11_divergence.ORACLE, "op12_suffixes": op12_suffixes.ORACLE, "op13_manifest": op13_manifest.ORACLE}
