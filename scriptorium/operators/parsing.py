"""Parsing of documents into sections, keyword hits and grammar blocks.

Every operator works within one row: sections and grammar blocks are cut from the array of a text's lines by
higher-order functions, so nothing is shuffled, and a long document meets no other one in a group. Only title, header
fields and front matter, which scan a text as a whole, run in Python, on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import keywords, plain_lines
from scriptorium.schema import GRAMMAR_STYLES

# Patterns of headings, grammar rules and page lines. White space in a page line is kept from crossing a
# line end, so that the line after it stays.
HEADING = r"^(\d+(?:\.\d+)*|Appendix\s+[A-Z](?:\.\d+)*)\.\s+(.+?)$"
RULE = r"^\s*([a-zA-Z][a-zA-Z0-9-]*)\s*=\s*/?\s*"
PAGE_HEADER = r"(?m)^[^\S\r\n]*RFC[^\S\r\n]+\d+[^\S\r\n]+.*$"
PAGE_FOOTER = r"(?m)^[^\S\r\n]*\[Page\s+\d+\]$"
# Line patterns of the grammar styles.
STYLE_PATTERNS = {
    "cddl": r"^\s*\w[\w-]*\s*=\s*[\{\(]|^\s*\w[\w-]*\s*=\s*\w[\w-]*\s*(?:/|\()",
    "asn.1": r"^\w[\w-]*\s+::=|\s*DEFINITIONS\s+::",
    "tls-presentation-lang": r"^\s*struct\s*\{|^\s*enum\s*\{|^\s*select\s*\(",
    "abnf": RULE,
}
STATUS_LINE = "status of this memo"


# --- whole-text scans ---------------------------------------------------------------------------------------------


def title_above(text: str, marker: str, fold: bool) -> str | None:
    """The indented lines nearest above the first ``marker``, joined; None if there are none."""
    at = (text.lower() if fold else text).find(marker.lower() if fold else marker)
    if at <= 0:
        return None
    block: list[str] = []
    for line in reversed(text[:at].split("\n")):
        bare = line.rstrip()
        indented = len(line) > 5 and line.startswith(" " * 5) and bool(bare)
        if indented:
            block.append(bare)
        elif block:
            break
    return " ".join(reversed(block)).strip() or None


def title_of(text: str, number: int | None) -> str:
    """Above ``Abstract``, else above the status heading, else ``RFC n``."""
    return title_above(text, "Abstract", False) or title_above(text, STATUS_LINE, True) or f"RFC {number or 0}"


NAMED_LINE = re.compile(r"\s*([A-Za-z][A-Za-z /]*):\s*(.*)")


def header_fields(text: str) -> dict[str, str]:
    """The first value of each ``Name: value`` line; a value runs on until the next name or a blank line."""
    found: dict[str, str] = {}
    name = None
    for line in text.split("\n"):
        named = NAMED_LINE.match(line)
        if named:
            name = named[1].strip()
            if name in found:
                name = None
            else:
                found[name] = named[2].strip()
        elif not line.strip():
            name = None
        elif name is not None:
            found[name] += "\n" + line.strip()
    return found


def numbers_of(value: str | None) -> list[int]:
    """``793``, ``RFC 793`` and ``4234 Author`` of a comma list; positive numbers only."""
    out = []
    for part in (value or "").split(","):
        found = re.match(r"\s*(?:RFC\s*)?([0-9]{1,9})", part, re.I)
        if found and int(found[1]) > 0:
            out.append(int(found[1]))
    return out


def authors_of(fields: dict[str, str]) -> list[str]:
    """P06."""
    value = fields.get("Authors", fields.get("Author", ""))
    return [a.strip() for a in value.split("\n")[0].split(",") if a.strip()]


def category_of(fields: dict[str, str]) -> str | None:
    """P04."""
    return fields.get("Category", "").split("\n")[0].strip() or None


def without_front_matter(text: str) -> str:
    """From the first line after the status heading's paragraph that is neither blank nor indented."""
    at = text.lower().find(STATUS_LINE)
    if at < 0:
        return text
    begin = at + len(STATUS_LINE)
    while begin < len(text):
        end = text.find("\n", begin)
        if end < 0:
            return text
        if begin < end and not text[begin].isspace():
            return text[begin:]
        begin = end + 1
    return text


HEADER = "title string, category string, rfc_date string, issn string, updates array<int>, obsoletes array<int>, authors array<string>, body string"


def with_header(files: DataFrame) -> DataFrame:
    """P02-P06, P09 for rows of rfc_number, text: adds the header's columns and ``body`` without front matter."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            at = batch.schema.get_field_index("text")
            number = batch.schema.get_field_index("rfc_number")
            for text, n in zip(batch.column(at).to_pylist(), batch.column(number).to_pylist()):
                plain = (text or "").replace("\0", "").replace("\r\n", "\n")
                fields = header_fields(plain)
                rows.append((title_of(plain, n), category_of(fields), fields.get("Date"), fields.get("ISSN"), numbers_of(fields.get("Updates")), numbers_of(fields.get("Obsoletes")), authors_of(fields), without_front_matter(plain)))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.string()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*batch.schema.names, *(c.split()[0] for c in HEADER.split(", "))])

    schema = ", ".join(f"`{n}` {k}" for n, k in files.dtypes)
    return files.mapInArrow(scan, f"{schema}, {HEADER}")


# --- line-wise operators ------------------------------------------------------------------------------------------


def without_pages(text: Column | str) -> Column:
    """Lines that begin ``RFC n ...`` and lines of ``[Page n]`` alone become empty."""
    plain = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(plain, PAGE_HEADER, ""), PAGE_FOOTER, "")


def without_contents(text: Column | str) -> Column:
    """P10: the first table of contents, up to the next numbered line."""
    return F.regexp_replace(text, r"(?sm)\A(.*?)^[^\S\n]*Table of Contents\s*$.*?(?=^\d+\.\s)", "$1")


def lines(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row a line: the kept columns, ``pos`` from 0 and ``line``; a null text has none."""
    return df.select(*keep, F.posexplode(plain_lines(text)).alias("pos", "line"))


def runs_from(df: DataFrame, text: Column, marks: dict[int, Callable[[Column], Column]], *keep: str) -> DataFrame:
    """(keep, lines, runs): the lines of a text, and for each line with a mark its index ``at``, its ``kind`` and the index
    ``until`` of the next such line, or of the end. The first mark whose test a line passes is its kind."""

    def kind(line: Column) -> Column:
        found: Column | None = None
        for number, test in marks.items():
            found = F.when(test(line), number) if found is None else found.when(test(line), number)
        assert found is not None
        return found

    cut = df.select(*keep, plain_lines(text).alias("lines"))
    marked = cut.withColumn("marks", F.filter(F.transform("lines", lambda line, at: F.struct(at.alias("at"), kind(line).alias("kind"))), lambda m: m["kind"].isNotNull()))
    ahead = F.slice("marks", 2, F.greatest(F.size("marks"), F.lit(1)))
    runs = F.zip_with("marks", ahead, lambda m, n: F.struct(m["at"].alias("at"), m["kind"].alias("kind"), n["at"].alias("until")))
    return marked.withColumn("runs", F.filter(runs, lambda r: r["at"].isNotNull())).select(*keep, "lines", "runs")


def run_text(run: Column, first: Column) -> Column:
    """The lines of a run joined, ``first`` in place of its first one."""
    rest = F.slice("lines", run["at"] + 2, F.coalesce(run["until"], F.size("lines")) - run["at"] - 1)
    return F.array_join(F.concat(F.array(first), rest), "\n")


def split_sections(documents: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, ordinal, section, heading, text): runs of lines from one heading to the next; text before the first
    heading and sections without text are dropped. The heading is the first line of the text."""

    def section(run: Column) -> Column:
        head = lambda group: F.regexp_extract(F.get("lines", run["at"]), HEADING, group)
        return F.struct(head(1).alias("section"), head(2).alias("heading"), F.regexp_replace(run_text(run, head(2)), r"\A\s+|\s+\z", "").alias("text"))

    found = runs_from(documents, F.col(text), {1: lambda line: line.rlike(HEADING)}, key)
    each = found.select(key, F.posexplode(F.transform("runs", section)).alias("ordinal", "s"))
    return each.where("s.text != ''").select(key, (F.col("ordinal") + 1).cast("int").alias("ordinal"), "s.section", "s.heading", "s.text")


def keyword_hits(sections: DataFrame) -> DataFrame:
    """(section_id, rfc_number, keyword, line_offset): one row for each keyword in each line; narrow, no shuffle."""
    return lines(sections, F.col("id").alias("section_id"), "rfc_number").select("section_id", "rfc_number", F.explode(keywords("line")).alias("keyword"), F.col("pos").alias("line_offset"))


def grammar_blocks(sections: DataFrame) -> DataFrame:
    """(section_id, rfc_number, section, block_no, abnf_text, rule_names): each rule line and the indented,
    non-blank lines after it that are no rule."""
    rule, ending = 1, 2
    marks = {rule: lambda line: line.rlike(RULE), ending: lambda line: (F.trim(line) == "") | ~line.rlike(r"^\s")}
    held = sections.where(F.col("text").rlike("(?m)" + RULE)).withColumnRenamed("id", "section_id")
    found = runs_from(held, F.col("text"), marks, "section_id", "rfc_number", "section")
    blocks = F.transform(F.filter("runs", lambda r: r["kind"] == rule), lambda r: run_text(r, F.get("lines", r["at"])))
    each = found.select("section_id", "rfc_number", "section", F.posexplode(blocks).alias("block_no", "abnf_text"))
    return each.select("section_id", "rfc_number", "section", (F.col("block_no") + 1).cast("int").alias("block_no"), "abnf_text", rule_names("abnf_text").alias("rule_names"))


def rule_names(text: Column | str) -> Column:
    """Names of the rules of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?m)" + RULE), F.lit(1)))


def grammar_styles(sections: DataFrame) -> DataFrame:
    """(rfc_number, abnf, tls, cddl, asn1, grammar_style): lines of each style and the style of the document.

    A line of CDDL counts for nothing else. A style with more than half of the lines wins, else the most frequent
    one; ties go in the order of the styles, and without any line the style is none.
    """
    cddl = F.col("line").rlike(STYLE_PATTERNS["cddl"])
    count = lambda test: F.sum(test.cast("int"))
    counted = lines(sections, "rfc_number").groupBy("rfc_number").agg(
        count(~cddl & F.col("line").rlike(STYLE_PATTERNS["abnf"])).alias("abnf"),
        count(~cddl & F.col("line").rlike(STYLE_PATTERNS["tls-presentation-lang"])).alias("tls"),
        count(cddl).alias("cddl"),
        count(~cddl & F.col("line").rlike(STYLE_PATTERNS["asn.1"])).alias("asn1"),
    )
    names = dict(zip(("abnf", "tls", "cddl", "asn1"), GRAMMAR_STYLES))
    total, most = sum(F.col(c) for c in names), F.greatest(*names)
    style = F.when(total == 0, "none")
    for column, name in names.items():
        style = style.when(F.col(column) > F.floor(total / 2), name)
    for column, name in names.items():
        style = style.when(F.col(column) == most, name)
    return counted.withColumn("grammar_style", style)
