"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, fingerprints, hnsw, merkle, minhash, mixing, packing, pii, secrets, spelling, toxicity, urls

QUERIES = {
    "op1_secrets": secrets.op1,
    "op2_token_ids": packing.op2,
    "op3_fingerprints": fingerprints.op3,
    "op4_personal_data": pii.op4,
    "op5_packing": packing.op5,
    "op6_minhash": minhash.op6,
    "op7_urls": urls.op7,
    "op8_toxicity": toxicity.op8,
    "op9_mixing": mixing.op9,
    "op10_embeddings": hnsw.op10,
    "op11_merkle": merkle.op11,
    "op12_decontamination": decontamination.op12,
    "op13_spelling": spelling.op13,
}
ORACLE_SQL = {"op7_urls": urls.OP7_SQL, "op11_merkle": merkle.OP11_SQL, "op12_decontamination": decontamination.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
