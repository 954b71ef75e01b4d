"""Mirror files as DataFrames."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import document_number


def expand(path: str) -> str:
    """``~`` and ``~/x`` name the home folder."""
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def discover(spark: SparkSession, mirror: str, parser: str = "text") -> DataFrame:
    """(rfc_number, source_path, content, source_sha256, text), one file for each number.

    A text file goes before an XML file, which counts only with the XML parser; of several the least path. Names
    without a number are skipped. The digest is of the bytes; malformed bytes become replacement characters.
    """
    root = expand(mirror).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,xml,TXT,XML,Txt,Xml}").load(root)
    named = files.select(document_number("path").alias("rfc_number"), "path", "content", F.lower(F.col("path")).endswith(".xml").alias("is_xml")).where("rfc_number is not null")
    if parser != "xml":
        named = named.where("not is_xml")
    # files are chosen by their paths alone; the few that another one outranks are left out of the read by an anti join,
    # whose small side is broadcast, so contents aren't shuffled
    place = Window.partitionBy("rfc_number").orderBy("is_xml", "path")
    outranked = named.select("rfc_number", "path", "is_xml").withColumn("at", F.row_number().over(place)).where("at > 1").select("path")
    kept = named.join(outranked, "path", "left_anti")
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + root + "\\E/", "")
    return kept.select("rfc_number", relative.alias("source_path"), "is_xml", F.upper(F.sha2("content", 256)).alias("source_sha256"), decoded("content").alias("text"))


def decoded(content: str) -> Column:
    """UTF-8 text without NUL characters; malformed bytes are replaced."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace").replace("\0", "").removeprefix("﻿"))

    return read(content)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node if local(c.tag) == name]


def text_of(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def parse_xml(text: str) -> dict:
    """Title, date, category, authors and sections (section, heading, text); malformed XML is empty.

    Sections are numbered depth first; one without text of its own keeps its number but isn't listed. Back matter is
    ignored.
    """
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return {"title": "", "rfc_date": None, "category": None, "authors": [], "sections": []}
    every = list(root.iter())
    first = lambda name: next((n for n in every if local(n.tag) == name), None)
    title, date = first("title"), first("date")
    authors = [a for n in every if local(n.tag) == "author" and (a := (n.get("fullname") or n.get("surname") or "").strip())]
    found: list[tuple[str, str | None, str]] = []

    def walk(parent: ET.Element, prefix: str) -> None:
        for number, node in enumerate(children(parent, "section"), 1):
            name = f"{prefix}{number}"
            head = node.get("title") or next((text_of(n) for n in children(node, "name")), None)
            body = "\n\n".join(t for t in map(text_of, children(node, "t")) if t)
            if body:
                found.append((name, head, body))
            walk(node, name + ".")

    middle = first("middle")
    walk(root if middle is None else middle, "")
    return {"title": text_of(title) if title is not None else "", "rfc_date": date.get("year") if date is not None else None, "category": root.get("category"), "authors": authors, "sections": found}


XML = "title string, rfc_date string, category string, authors array<string>, sections array<struct<section:string,heading:string,text:string>>"


def with_xml(files: DataFrame) -> DataFrame:
    """Rows of XML files (rfc_number, text) with what :func:`parse_xml` gives."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.struct([("section", pa.string()), ("heading", pa.string()), ("text", pa.string())])
        for batch in batches:
            parsed = [parse_xml(t or "") for t in batch.column(1).to_pylist()]
            sections = [[dict(zip(("section", "heading", "text"), s)) for s in p["sections"]] for p in parsed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([p[c] for p in parsed], pa.string()) for c in ("title", "rfc_date", "category")), pa.array([p["authors"] for p in parsed], pa.list_(pa.string())), pa.array(sections, pa.list_(row))],
                ["rfc_number", "title", "rfc_date", "category", "authors", "sections"],
            )

    return files.select("rfc_number", "text").mapInArrow(scan, f"rfc_number int, {XML}")
