"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat
from .collocations import OP12_SQL, op12_collocations
from .decontam import op3_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .langid import op9_langid
from .licenses import op4_licenses
from .lines import OP11_SQL, op11_line_dedup
from .media import op8_media
from .packing import op6_packing
from .sharding import op1_sharding
from .simhash import op7_simhash
from .substring import op5_substring
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_chat": op2_chat,
    "op3_decontamination": op3_decontamination,
    "op4_licenses": op4_licenses,
    "op5_substring": op5_substring,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_media": op8_media,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op2_chat": OP2_SQL, "op10_warc": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_filter_audit": OP13_SQL}
