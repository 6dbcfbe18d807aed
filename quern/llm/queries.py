"""The registered queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from quern.llm.decontam import op7_benchmark_decontamination
from quern.llm.fingerprint import op1_document_fingerprints
from quern.llm import jaccard_join, substring_dedup, warc
from quern.llm.jaccard_join import op6_ngram_jaccard_join
from quern.llm.langid import op2_language_id
from quern.llm.packing import op4_packing
from quern.llm.secret_scan import op8_secret_scans
from quern.llm.substring_dedup import op9_substring_dedup
from quern.llm.toxicity import op3_toxicity
from quern.llm.urlfilter import op10_url_filters
from quern.llm.warc import op5_warc

QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_secret_scans": op8_secret_scans,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filters": op10_url_filters,
}

ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op6_ngram_jaccard_join": jaccard_join.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
}
