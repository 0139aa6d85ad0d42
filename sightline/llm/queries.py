"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op7_chat_quotation
from .decontam import op1_decontamination
from .html_extract import op2_html_extraction
from .lexical import OP12_SQL, op12_lexical_search
from .packing import op11_packing
from .pii import op9_pii
from .quality import op6_quality
from .resampling import OP13_SQL, op13_resampling
from .sentencepiece_scan import op4_sentencepiece
from .sharding import op10_sharding
from .simhash import op8_simhash
from .toxicity import op3_toxicity
from .url_filter import OP5_SQL, op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_toxicity, op4_sentencepiece, op5_url_filter, op6_quality, op7_chat_quotation, op8_simhash, op9_pii, op10_sharding, op11_packing, op12_lexical_search, op13_resampling)}
ORACLE_SQL: dict[str, str] = {"op5_url_filter": OP5_SQL, "op12_lexical_search": OP12_SQL, "op13_resampling": OP13_SQL}
