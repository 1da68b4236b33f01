"""Title and person-name normalisation as built-in Column expressions.

Everything here is a pure ``Column -> Column`` function: no Python runs per
row, so the expressions stay inside whole-stage code generation (the array
ones are higher-order functions evaluated inside the same stage).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Fixed values (must equal the reference for equal keys):
#   Ё (U+0401) and ё (U+0451) both become е (U+0435) before case mapping.
YO_CHARS = "Ёё"
YO_TARGET = "ее"
# Blank characters removed by the trim helpers (space, tab, LF, CR, FF).
BLANKS = " \t\n\r\f"

_NOT_ALPHABETIC = r"[^\p{IsAlphabetic}]"
_MAX = 2147483647


def trim_to_null(c) -> Column:
    """Trim blanks; an empty result is NULL."""
    return F.nullif(F.trim(col(c), F.lit(BLANKS)), F.lit(""))


def letters_only(c) -> Column:
    """Keep Unicode Alphabetic characters only, Ё/ё mapped to е."""
    return F.regexp_replace(F.translate(col(c), YO_CHARS, YO_TARGET), _NOT_ALPHABETIC, "")


def _title_case(s) -> Column:
    """First letter upper case (full mapping), the rest lower case."""
    rest = F.lower(F.translate(F.substring(s, 2, _MAX), "Σ", "σ"))
    return F.concat(F.upper(F.substring(s, 1, 1)), rest)


def norm_chunk(c) -> Column:
    """Letters only, first letter upper case, the rest lower case.

    Full Unicode case mapping (``ß`` -> ``SS`` when first).  A capital sigma
    is mapped to ``σ`` before lower-casing, so the result does not depend on
    the position of the letter in the word (per-character mapping).
    Empty -> NULL.
    """
    return F.nullif(_title_case(letters_only(c)), F.lit(""))


def norm_name(c) -> Column:
    """Split on ``-``, normalise each chunk, drop empty ones, join with ``-``.

    The letter filter runs once per chunk (first ``transform``), the case
    mapping on its result (second ``transform``).
    """
    letters = F.transform(F.split(col(c), "-"), letters_only)
    parts = F.filter(F.transform(letters, _title_case), lambda x: x != "")
    return F.nullif(F.array_join(parts, "-"), F.lit(""))


def norm_title(c) -> Column:
    """D3: blank title -> NULL, else :func:`norm_name`."""
    c = col(c)
    return F.when(F.trim(c, F.lit(BLANKS)) == "", F.lit(None).cast("string")).otherwise(norm_name(c))


def person_key(last, first, middle) -> Column:
    """Normalised last, first, middle joined by one blank; all empty -> NULL."""
    return F.nullif(F.concat_ws(" ", norm_name(last), norm_name(first), norm_name(middle)), F.lit(""))


def name_parts(c) -> Column:
    """Blank-separated, trimmed, non-empty parts of a name string."""
    raw = F.transform(F.split(col(c), " "), lambda x: F.trim(x, F.lit(BLANKS)))
    return F.filter(raw, lambda x: x != "")


def person_from_string(c) -> Column:
    """``"Last [First [Middle]]"`` -> person struct.

    Returns ``struct(id, first_name, middle_name, last_name, error)``; 0 or
    more than 3 parts, or a name that normalises to nothing, give NULL
    fields and a non-NULL ``error``.
    """
    parts = name_parts(c)
    n = F.size(parts)
    ok_shape = (n >= 1) & (n <= 3)
    last = F.when(ok_shape, F.get(parts, 0))
    first = F.when(ok_shape, F.get(parts, 1))
    middle = F.when(ok_shape, F.get(parts, 2))
    key = person_key(last, first, middle)
    error = (F.when(~ok_shape, F.lit("cannot parse person: expected 'Last First Middle'"))
             .when(key.isNull(), F.lit("person name normalises to nothing")))
    good = error.isNull()
    return F.struct(
        F.when(good, key).alias("id"),
        F.when(good, first).alias("first_name"),
        F.when(good, middle).alias("middle_name"),
        F.when(good, last).alias("last_name"),
        error.alias("error"),
    )


def alias_key(c) -> Column:
    """Key an alias string is matched on: each blank-separated part through
    :func:`norm_name`, empty parts dropped, joined with one blank."""
    normed = F.filter(F.transform(name_parts(c), norm_name), lambda x: x.isNotNull())
    return F.nullif(F.array_join(normed, " "), F.lit(""))
