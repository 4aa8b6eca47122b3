"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, fingerprints, fixity, hard_negatives, near_dedup, ppm
from . import packing, pieces, quality, sort_means, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op4_packing": packing.op4_packing,
    "op2_fixity": fixity.op2_fixity,
    "op3_quality": quality.op3_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pieces": pieces.op6_pieces,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op11_lm_scores": ppm.op11_lm_scores,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_centroid_clusters": sort_means.op13_centroid_clusters,
}

ORACLE_SQL = {
    "op2_fixity": fixity.OP2_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_centroid_clusters": sort_means.OP13_SQL,
    "op7_exact_dedup": """
        with d as (
            select doc_id, length(coalesce(text, '')) as chars,
                sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
            from documents
        )
        select doc_id,
            first(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
            count(*) over (partition by text_sha256) as group_size,
            row_number() over (partition by text_sha256 order by chars desc, doc_id) = 1 as kept,
            text_sha256
        from d
    """,
}
