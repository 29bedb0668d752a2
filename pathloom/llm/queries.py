"""The registered queries of this subpackage and their SQL."""

from pathloom.llm import chat, classifier, html, idstore, media, mixing, packing, rules, secrets, simhash

QUERIES = {
    "op1_chat_format": chat.op1,
    "op2_source_mix": mixing.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_html_extract": html.op4,
    "op5_mixture_pack": packing.op5,
    "op6_secret_scan": secrets.op6,
    "op7_id_store": idstore.op7,
    "op8_quality_classifier": classifier.op8,
    "op9_quality_rules": rules.op9,
    "op10_media_sniff": media.op10,
}
SQL = {"op1_chat_format": chat.OP1_SQL, "op9_quality_rules": rules.OP9_SQL}
