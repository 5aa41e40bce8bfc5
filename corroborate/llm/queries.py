"""The queries of the text operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from corroborate.llm import bpe, chunks, crosstok, cuckoo, divergence, ppm, quality, secrets, sharding, simhash, suffixes, templates, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_bpe": bpe.op2,
    "op3_chunks": chunks.op3,
    "op4_exact_dedup": cuckoo.op4,
    "op5_ppm": ppm.op5,
    "op6_decontamination": templates.op6,
    "op7_secrets": secrets.op7,
    "op8_simhash": simhash.op8,
    "op9_sharding": sharding.op9,
    "op10_suffixes": suffixes.op10,
    "op11_crosstok": crosstok.op11,
    "op12_quality": quality.op12,
    "op13_divergence": divergence.op13,
}

ORACLES = {
    "op4_exact_dedup": cuckoo.OP4_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
