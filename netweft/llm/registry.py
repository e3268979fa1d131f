"""The queries of this subpackage by name, and SQL for those that SQL can express."""
from __future__ import annotations

import corpus_pipeline
from netweft.llm.byte_bpe import op8_byte_bpe
from netweft.llm.decontamination import op7_decontamination
from netweft.llm.language import op9_language
from netweft.llm.media import op2_media
from netweft.llm.minhash import op1_minhash
from netweft.llm.oracles import ORACLES
from netweft.llm.pii import op10_pii
from netweft.llm.quality import op5_quality
from netweft.llm.repeats import op3_repeats
from netweft.llm.token_files import op6_token_files
from netweft.llm.warc import op4_warc

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op9_language": op9_language,
    "op2_media": op2_media,
    "op3_repeats": op3_repeats,
    "op5_quality": op5_quality,
    "op7_decontamination": op7_decontamination,
    "op1_minhash": op1_minhash,
    "op4_warc": op4_warc,
    "op6_token_files": op6_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op10_pii": op10_pii,
}
