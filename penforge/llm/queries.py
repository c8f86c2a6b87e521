"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, html_text, merkle, ngram_join, pii, quality, sharding, token_orc, toxicity, whitening

QUERIES = {
    "op1_quality_qda": quality.op1_quality_qda,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_html_text": html_text.op3_html_text,
    "op4_token_orc": token_orc.op4_token_orc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
    "op9_pii": pii.op9_pii,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_whitening": whitening.op11_whitening,
    "op12_chat_format": chat.op12_chat_format,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op12_chat_format": chat.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
