"""File-name sanitising (H1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Characters replaced by "_" are / \ : * ? " < > | and U+0000-U+001F;
# an over-long name gets "…" (U+2026) appended; an empty one becomes "unnamed".
_FORBIDDEN = r'[/\\:*?"<>|\x00-\x1F]'
ELLIPSIS = "…"
UNNAMED = "unnamed"


def utf8_prefix(c, max_bytes: int) -> Column:
    """Longest prefix of ``c`` whose UTF-8 form fits in ``max_bytes`` bytes.

    Cuts the bytes, repairs a split trailing character with
    ``make_valid_utf8`` and drops the repaired tail again, so the result
    never holds half a character.
    """
    c = col(c)
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, max_bytes).cast("string"))
    n = F.char_length(cut)
    candidates = [cut] + [F.substring(cut, 1, n - k) for k in (1, 2, 3)]
    expr = None
    for cand in candidates:
        cond = F.startswith(c, cand)
        expr = F.when(cond, cand) if expr is None else expr.when(cond, cand)
    return expr.otherwise(F.lit(""))


def sanitize(c, max_len: int = 0) -> Column:
    """H1: forbidden characters -> ``_``, trim blanks, cut to ``max_len``
    UTF-8 bytes at a character boundary plus ``…``, empty -> ``unnamed``."""
    s = F.trim(F.regexp_replace(col(c), _FORBIDDEN, "_"))
    if max_len and max_len > 0:
        s = F.when(F.octet_length(s) > max_len,
                   F.concat(utf8_prefix(s, max_len), F.lit(ELLIPSIS))).otherwise(s)
    return F.when(s == "", F.lit(UNNAMED)).otherwise(s)
