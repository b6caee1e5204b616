"""Column functions over text: lines, folding, tokens, trimming."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All line ends of a Unicode text (fixed values).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: White space as text tools strip it.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as characters, and those of them that are no line ends.
_IN_LINE = "\t\x1f \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_SPACES = _IN_LINE + "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
WORD = r"[\p{L}\p{N}\p{Co}]+"
TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters (Latin-1, Extended-A, Extended Additional) and their base letters, from their decompositions."""
    pairs = [(c, b) for c in map(chr, [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)]) if (d := unicodedata.normalize("NFD", c)) != c and (b := d[0]).isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _fold_table()


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def tidy_lines(text: Column) -> Column:
    """Every line right-trimmed, no blank lines at either end."""
    lines = F.transform(split_lines(text), lambda x: F.rtrim(x, F.lit(_IN_LINE)))
    return F.btrim(F.array_join(lines, "\n"), F.lit("\n"))


def one_line(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def fold(text: Column) -> Column:
    return F.lower(F.translate(text, _ACCENTED, _BASE))


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits without diacritics, in order."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def parse_time(raw: Column) -> Column:
    """A timestamp from ISO text (with or without ``Z``) or epoch seconds; null where it is neither."""
    epoch = F.timestamp_seconds(raw.try_cast("double"))
    return F.when(raw.rlike(r"^\d+(\.\d+)?$"), epoch).otherwise(raw.try_cast("timestamp"))
