"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .decontaminate import OP9_SQL, op9_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .jaccard import op7_jaccard_join
from .language_id import op1_language_id
from .language_model import op4_language_model
from .merkle import OP12_SQL, op12_merkle_manifest
from .neighbours import op8_neighbours
from .quality import op11_quality
from .repeats import op3_suffix_dedup
from .token_files import op6_token_files
from .url_filter import OP10_SQL, op10_url_filters
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_model": op4_language_model,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_neighbours": op8_neighbours,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_quality": op11_quality,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_divergence": op13_source_divergence,
}
SQL = {"op5_warc": OP5_SQL, "op9_decontamination": OP9_SQL, "op10_url_filters": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}
