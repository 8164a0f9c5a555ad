"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from plumbline.llm.bpe import op13_bpe
from plumbline.llm.clusters import op11_clusters, op11_sql
from plumbline.llm.language import op4_language
from plumbline.llm.licenses import op9_licenses, op9_sql
from plumbline.llm.media import op7_media
from plumbline.llm.mixing import op5_mixing
from plumbline.llm.negatives import OP12_SQL, op12_hard_negatives
from plumbline.llm.packing import op3_packing
from plumbline.llm.quality import op1_quality
from plumbline.llm.rules import op8_quality_rules
from plumbline.llm.secrets import op6_secrets
from plumbline.llm.simhash import op10_simhash
from plumbline.llm.tokens import op2_token_counts

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_media": op7_media,
    "op8_quality_rules": op8_quality_rules,
    "op9_licenses": op9_licenses,
    "op10_simhash": op10_simhash,
    "op11_clusters": op11_clusters,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe": op13_bpe,
}

ORACLE = {"op9_licenses": op9_sql(), "op11_clusters": op11_sql(), "op12_hard_negatives": OP12_SQL}
