"""Text functions on columns: normalisation, short texts, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java classes for Unicode word characters, white space and digits.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
DIGIT = r"\p{Nd}"


#: What a white-space strip takes away at either end.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalize_text(text: Column) -> Column:
    """Drop a leading word that ends in ``-``, ``.`` or ``)``, then a leading decimal number;
    lower-case, delete all but word characters and white space, collapse white space.

    Both prefixes go in one match from the start, so that neither is looked for further on.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_extract(t, rf"(?sU)^(?:[{WORD}]+[-.)][{SPACE}]*)?(?:{DIGIT}+[.]{DIGIT}+[{SPACE}]*)?(.*)$", 1)
    t = F.regexp_replace(F.lower(t), rf"(?U)[^{WORD}{SPACE}]+", "")
    return F.trim(F.regexp_replace(t, rf"(?U)[{SPACE}]+", " "))


def short_text(text: Column) -> Column:
    """Lower-case without white space at either end."""
    return F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))


def page_file(name: Column) -> tuple[Column, Column]:
    """doc_id and page of ``<doc_id>_page_<number>.png``; both null for other names."""
    pattern = r"^(.*)_page_(\d+)\.png"
    fits = name.rlike(pattern)
    return F.when(fits, F.regexp_extract(name, pattern, 1)), F.when(fits, F.regexp_extract(name, pattern, 2).cast("int"))


def tail(text: Column, n: int = 200) -> Column:
    return F.right(text, F.lit(n))


# The same in DuckDB SQL, whose patterns know ASCII white space only.
def normalize_sql(text: str) -> str:
    t = f"regexp_replace(coalesce({text}, ''), '^[{WORD}]+[-.)]\\s*', '')"
    t = f"regexp_replace({t}, '^{DIGIT}+[.]{DIGIT}+\\s*', '')"
    t = f"regexp_replace(lower({t}), '[^{WORD}\\s]', '', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def short_sql(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '^\\s+|\\s+$', '', 'g')"
