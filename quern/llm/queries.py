"""The queries and SQL of this subpackage."""

from __future__ import annotations

from quern.llm import decontaminate, langid, licenses, linededup, neardup, packing, quality, substrings, tokenfile, warc

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_pack,
        substrings.op2_substring_dedup,
        licenses.op3_license_scan,
        warc.op4_warc_revisits,
        neardup.op5_near_duplicates,
        langid.op6_language,
        quality.op7_quality,
        linededup.op8_line_dedup,
        tokenfile.op9_token_files,
        decontaminate.op10_decontaminate,
    )
}
ORACLES = {
    "op2_substring_dedup": substrings.SQL,
    "op3_license_scan": licenses.SQL,
    "op4_warc_revisits": warc.SQL,
    "op5_near_duplicates": neardup.SQL,
    "op7_quality": quality.SQL,
    "op8_line_dedup": linededup.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
