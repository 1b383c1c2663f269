"""Regular expressions with Python semantics on the JVM.

Log rules and formats are written in Python's dialect, where ``\\d \\w \\s \\b``
are Unicode aware, case folding is Unicode and only ``\\n`` ends a line.  The
inline flags below give Java's engine the same behaviour.  Python also counts the
four separators U+001C to U+001F as white space, which the flags do not cover.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"
EXTRA_SPACE = r"\x1c-\x1f"


def _spaces(pattern: str) -> str:
    """The pattern with white-space escapes widened to Python's meaning."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if token == r"\s":
            out.append(rf"\s{EXTRA_SPACE}" if inside else rf"[\s{EXTRA_SPACE}]")
        elif token == r"\S" and not inside:
            out.append(rf"[^\s{EXTRA_SPACE}]")
        else:
            out.append(token)
            inside = token == "[" or (inside and token != "]")
        i += len(token)
    return "".join(out)


def py(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iudU)" if ignore_case else "(?dU)") + _spaces(pattern)


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides (``trim`` only drops blanks)."""
    return F.regexp_replace(F.regexp_replace(text, py(r"^\s+"), ""), py(r"\s+$"), "")


def packed_groups(text: Column, pattern: str, order: tuple[int, ...]) -> Column:
    """Groups of a whole-line pattern in the given order, behind separators.

    One replacement yields every group, so the pattern runs once per line and
    not once per group.  Group 0 stands for an absent field, an empty string.
    """
    template = "".join(SEPARATOR + (f"${i}" if i else "") for i in order)
    return F.regexp_replace(text, pattern, template)


def group_array(text: Column, pattern: str, order: tuple[int, ...]) -> Column:
    """The same groups, one extraction each: for lines that hold the separator."""
    return F.array(
        *[F.regexp_extract(text, pattern, i) if i else F.lit("") for i in order]
    )


def unpack_groups(packed: Column, count: int) -> Column:
    return F.slice(F.split(packed, SEPARATOR), 2, count)
