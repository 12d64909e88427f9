"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import bpe, decontam, linededup, minhash, ngram, quality, rangecoder, secretscan, tokcount, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_tokenblocks": rangecoder.op3_tokenblocks,
    "op4_quality": quality.op4_quality,
    "op5_decontam": decontam.op5_decontam,
    "op6_warc": warc.op6_warc,
    "op7_lmscore": ngram.op7_lmscore,
    "op8_linededup": linededup.op8_linededup,
    "op9_tokcount": tokcount.op9_tokcount,
    "op10_secrets": secretscan.op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": warc.SQL,
    "op8_linededup": linededup.SQL,
}
