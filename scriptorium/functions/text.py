"""Column functions over text: section order, keywords, tokens, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.schema import ERRATA_STATUSES, KEYWORD_PATTERN, STOP_WORDS

DOTTED = r"^[0-9]{1,9}(\.[0-9]{1,9})*$"


def plain_lines(text: Column | str) -> Column:
    """Lines of a text, with CR LF taken as one line end; null stays null."""
    return F.split(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\r\n"), F.lit("\n")), "\n")


def section_path(section: Column | str) -> Column:
    """Dotted numbers as an int array; null for anything else, which sorts last."""
    section = F.col(section) if isinstance(section, str) else section
    return F.when(section.rlike(DOTTED), F.transform(F.split(section, r"\."), lambda x: x.cast("int")))


def section_order(section: str = "section") -> list[Column]:
    return [section_path(section).asc_nulls_last(), F.col(section).asc_nulls_last()]


def lexemes(text: Column | str) -> Column:
    """Words of ``a-z0-9`` of the lower-cased text, two characters at least, without stop words."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def query_terms(query: Column | str) -> Column:
    """Q11: distinct lower-cased terms of three or more characters, split on fifteen separators."""
    query = F.col(query) if isinstance(query, str) else query
    return F.filter(F.array_distinct(F.split(F.lower(query), r"""[ \t\n.,?!()\[\]:;"']+""")), lambda w: F.length(w) >= 3)


def keywords(line: Column | str) -> Column:
    """Uppercase requirement keywords of a line, the longest at each place."""
    return F.regexp_extract_all(line, F.lit(KEYWORD_PATTERN), F.lit(1))


def normalized_status(status: Column | str) -> Column:
    """Trimmed, space and hyphen as underscore; known statuses in lower case, others keep theirs."""
    status = F.col(status) if isinstance(status, str) else status
    named = F.regexp_replace(F.trim(status), "[ -]", "_")
    return F.when(F.lower(named).isin(*ERRATA_STATUSES), F.lower(named)).otherwise(named)


def blank_to_null(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.nullif(F.trim(value), F.lit(""))


def evidence_id(document: Column | str, section: Column | str) -> Column:
    """``document#section``, ``document#*`` without a section."""
    section = F.col(section) if isinstance(section, str) else section
    return F.concat_ws("#", F.col(document) if isinstance(document, str) else document, F.coalesce(section, F.lit("*")))


def document_number(path: Column | str) -> Column:
    """Number of a file named ``rfc<digits>.txt`` or ``.xml`` in any case; null for other names."""
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)rfc([0-9]{1,9})\.(?:txt|xml)$", 1), F.lit("")).cast("int")
