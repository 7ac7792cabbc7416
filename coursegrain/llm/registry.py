"""Queries and SQL of this subpackage."""

from .embed_dup import OP5_SQL, op5_embedding_near_dedup
from .language_model import op7_log_bilinear
from .line_dedup import OP1_SQL, op1_line_dedup
from .media import op8_jpeg_media
from .mixing import OP4_SQL, op4_source_mix
from .near_dup import op10_order_minhash
from .packing import op2_best_fit_packing
from .phrases import OP12_SQL, op12_phrases
from .quality import op6_quality
from .secrets import op11_secret_scan
from .token_files import op3_token_files
from .warc import OP9_SQL, op9_warc_index
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op4_source_mix": op4_source_mix,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality": op6_quality,
    "op7_log_bilinear": op7_log_bilinear,
    "op8_jpeg_media": op8_jpeg_media,
    "op9_warc_index": op9_warc_index,
    "op10_order_minhash": op10_order_minhash,
    "op11_secret_scan": op11_secret_scan,
    "op12_phrases": op12_phrases,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op4_source_mix": OP4_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op9_warc_index": OP9_SQL,
    "op12_phrases": OP12_SQL,
}
