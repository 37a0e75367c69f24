"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from tessella.llm import ann, bpe, chat, exact, jaccard, kneser, langid, lexical, packing, quality, simhash, warc, whiten

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_exact_dedup": exact.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_chat_format": chat.op4,
    "op5_warc": warc.op5,
    "op6_nearest": ann.op6,
    "op7_language_id": langid.op7,
    "op8_kneser_ney": kneser.op8,
    "op9_packing": packing.op9,
    "op10_quality": quality.op10,
    "op11_lexical": lexical.op11,
    "op12_jaccard": jaccard.op12,
    "op13_whitening": whiten.op13,
}
ORACLES = {
    "op2_exact_dedup": exact.OP2_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op11_lexical": lexical.OP11_SQL,
}
