from tidelab.functions.text import (
    is_blank,
    is_date_like,
    js_trim,
    round_value,
    safe_string,
    to_number,
)
from tidelab.functions.hashing import fnv1a_unit, md5_unit
from tidelab.functions.naming import sanitize_identifier, unique_names

__all__ = [
    "is_blank",
    "is_date_like",
    "js_trim",
    "round_value",
    "safe_string",
    "to_number",
    "fnv1a_unit",
    "md5_unit",
    "sanitize_identifier",
    "unique_names",
]
