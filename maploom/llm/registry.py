"""The queries over the tables of a training-data corpus, and their SQL where there is one."""

from maploom.llm import alignment, byte_bpe, chat, exact_dedup, merkle, minhash, packing, quality, repeats, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc": warc.op2_warc,
    "op3_secrets": secrets.op3_secrets,
    "op4_packing": packing.op4_packing,
    "op5_chat": chat.op5_chat,
    "op6_repeats": repeats.op6_repeats,
    "op7_quality": quality.op7_quality,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle": merkle.op11_merkle,
    "op12_alignment": alignment.op12_alignment,
    "op13_minhash": minhash.op13_minhash,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
