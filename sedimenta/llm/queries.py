"""The queries of this subpackage and their SQL, by name."""

from . import bpe, chat, decontaminate, exact_dedup, license_scan, line_dedup, near_dedup, quality, secret_scan, suffix_dedup

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_bpe_encode": bpe.op4_bpe_encode,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_chat_format": chat.op10_chat_format,
}

ORACLES = {
    "op2_suffix_array_dedup": suffix_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
