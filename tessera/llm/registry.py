"""The corpus operators' queries, and SQL for those that SQL can express."""

from . import decontamination, jaccard, licences, mixing, records, secrets, sharding, suffixes, topk, toxicity

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_secrets": secrets.op2_secrets,
    "op3_licences": licences.op3_licences,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_records": records.op7_records,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_suffixes": suffixes.op10_suffixes,
}
SQL = {
    "op1_topk": topk.SQL,
    "op3_licences": licences.SQL,
    "op4_jaccard": jaccard.SQL,
    "op5_sharding": sharding.SQL,
    "op6_mixing": mixing.SQL,
    "op9_decontamination": decontamination.SQL,
    "op10_suffixes": suffixes.SQL,
}
