"""Texts that end before the file that was sent did.

Method: a trie of the corpus vocabulary, combined with length evidence. The trie is a table with one row for each
node (the prefix that leads to it, how often a word passes through, how often one ends there), so it is spread
over the cluster and never broadcast. A final token that is no word, or almost none, while many words pass
through its node, was cut. Further evidence: a cue number, timing line, tag or bracket that breaks off; a length
in characters or bytes at which far more files of the same source end than just beside it; a declared length
well beyond the text; and a final word that hardly ever ends a cue, in a file that otherwise closes its cues.

Marks put after a cut (an ellipsis or three dots) are looked through. Defined results: null, empty and blank
texts are no case; texts of one line or without cues are judged by their words and lengths alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.flat import may_hold
from scriptorium.llm.tokenizer import strings
from scriptorium.session import stage_table

WORD = re.compile(r"([^\W\d_]+(?:['’][^\W\d_]+)*)([^\w\s]?)")
FINAL_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*$")
TIMING = re.compile(r"\s*(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3} *--> *(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3}")
MARK = re.compile(r"\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\])\s*$")
OPEN = re.compile(r"<[^<>]*$|\[[^\[\]]*$|\{[^{}]*$|\([^()]*$")
BREAK = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
CLOSED = re.compile(r"[.!?…。！？♪♫*\])}>\"'”’»—–-]\s*$")
# The shapes of a timing line, d for a digit.
SHAPES = [f"{a} --> {b}" for a in ("dd:dd:dd,ddd", "dd:dd,ddd", "d:dd:dd,ddd", "d:dd,ddd") for b in ("dd:dd:dd,ddd", "dd:dd,ddd", "d:dd:dd,ddd", "d:dd,ddd")]
TAIL = "doc string, source string, declared long, chars long, bytes long, mark boolean, padded boolean, structure string, word string, before string, closes double, closed boolean, ends_in string, closing string, opening string"


def cue_texts(text: str) -> list[list[str]]:
    """Lines of each cue's block, in order."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n").strip("﻿ \t\n")
    return [[line.strip() for line in block.split("\n") if line.strip()] for block in BREAK.split(plain)] if plain else []


def spoken(block: list[str]) -> list[str]:
    """A block's lines after its number and timing."""
    for k, line in enumerate(block[:3]):
        if TIMING.match(line):
            return block[k + 1 :]
    return block


def breaks_off(blocks: list[list[str]]) -> str:
    """Which part of the last cue breaks off, if one does."""
    last = blocks[-1]
    line = last[-1]
    shape = re.sub(r"\d", "d", line).replace(".", ",")
    if not TIMING.match(line) and len(blocks) > 1:
        if any(s.startswith(shape) for s in SHAPES) and (":" in shape or len(last) == 2):
            return "timing"
        if len(last) == 1 and line.isdigit():
            return "number"
    if TIMING.match(line) and line is last[-1] and len(blocks) > 1 and len(last) <= 2:
        return "text"
    found = OPEN.search(line)
    if found and (found.group()[0] in "<{" or len(line) - found.start() < 60):
        return "bracket"
    return ""


def tail_of(text: str) -> tuple[tuple, list[list[str]]]:
    """What the end of a text tells, and the blocks of its cues."""
    bare = text.rstrip(" ")
    padded = len(text) - len(bare) > 1
    mark = MARK.search(bare)
    body = bare[: mark.start()] if mark else bare
    blocks = cue_texts(body)
    if not blocks:
        return (bool(mark), padded, "", None, None, 0.0, True, "blank", None, None), blocks
    structure = breaks_off(blocks)
    cues = [" ".join(spoken(b)) for b in blocks[:-1]]
    cues = [c for c in cues if c]
    closes = sum(1 for c in cues if CLOSED.search(c)) / len(cues) if cues else 0.0
    end = " ".join(spoken(blocks[-1]))
    word = FINAL_WORD.search(end)
    ends = "word" if word else "comma" if end.endswith((",", "，", "、")) else "other"
    before = WORD.findall(end[: word.start()]) if word else []
    told = (
        bool(mark),
        padded,
        structure,
        word.group().lower() if word and not structure else None,
        before[-1][0].lower() if before else None,
        closes,
        bool(CLOSED.search(end)),
        ends,
        end.lower() if len(end) <= 40 else None,
        end.lower()[:41],
    )
    return told, blocks


class Words:
    """Counts of a task's words by the cues that are known to be whole, passed on whenever they are many."""

    def __init__(self) -> None:
        self.every: Counter = Counter()
        self.final: Counter = Counter()
        self.penult: Counter = Counter()

    def add(self, blocks: list[list[str]]) -> None:
        for block in blocks:
            found = WORD.findall(" ".join(spoken(block)))
            self.every.update(found)
            if found and not found[-1][1]:
                self.final[found[-1][0]] += 1
                if len(found) > 1:
                    self.penult[found[-2][0]] += 1

    def flush(self) -> list[tuple[str, int, int, int, int]]:
        """(word, n, bare, final, penult) in lower case."""
        out: dict[str, list[int]] = {}
        for (word, mark), n in self.every.items():
            row = out.setdefault(word.lower(), [0, 0, 0, 0])
            row[0] += n
            row[1] += 0 if mark else n
        for place, counts in ((2, self.final), (3, self.penult)):
            for word, n in counts.items():
                out[word.lower()][place] += n
        for counts in (self.every, self.final, self.penult):
            counts.clear()
        return [(word, *row) for word, row in out.items()]


VOCABULARY = "kind string, word string, n long, bare long, final long, penult long"


def scanned(df: DataFrame, key: str, text: str, source: str, declared: str) -> tuple[DataFrame, DataFrame]:
    """(tails, words), from one scan of the texts.

    Tails: what the end of each text tells. Words: (word, n, bare, final, penult): occurrences, those no mark follows, of
    these the ones that end a cue, and those that stand just before a word which ends a cue without a mark. The last cue
    of each text teaches nothing, since it may be cut.
    """
    fields = [c.split() for c in f"{TAIL}, {VOCABULARY.replace('word string', 'token string')}".split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in fields])
    split = len(TAIL.split(", "))

    def counted(words: Words) -> pa.RecordBatch:
        rows = words.flush()
        columns = list(zip(*rows)) if rows else [()] * 5
        nothing = [pa.nulls(len(rows), f.type) for f in list(schema)[:split]]
        return pa.RecordBatch.from_arrays([*nothing, pa.array(["word"] * len(rows), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[split + 1 :]))], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts, rows = strings(batch.column(3)), []
            for value in texts:
                told, blocks = tail_of(value)
                rows.append(told)
                words.add(blocks[:-1])
            columns = list(zip(*rows)) if rows else [()] * 10
            lengths = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())]
            told = [*(batch.column(i) for i in range(3)), *lengths, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[5:split]))]
            yield pa.RecordBatch.from_arrays([*told, pa.array(["tail"] * len(texts), pa.string()), *(pa.nulls(len(texts), f.type) for f in list(schema)[split + 1 :])], schema=schema)
            if len(words.every) > 300_000:
                yield counted(words)
        yield counted(words)

    rows = df.select(F.col(key).cast("string").alias("doc"), F.lower(F.trim(source)).alias("source"), F.col(declared).cast("long").alias("declared"), F.col(text).alias("text")).where("text is not null and doc is not null")
    both = stage_table(rows.mapInArrow(scan, ", ".join(" ".join(f) for f in fields)), ("kind",))
    ends = both.where("kind = 'tail' and ends_in != 'blank'").select(*(c.split()[0] for c in TAIL.split(", ")))
    words = both.where("kind = 'word'").groupBy(F.col("token").alias("word")).agg(*(F.sum(c).alias(c) for c in ("n", "bare", "final", "penult")))
    return ends, words


def trie(words: DataFrame) -> DataFrame:
    """(node, through): how often words pass through the node of a prefix without ending there."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(F.lit(1), i))
    return words.where("length(word) between 2 and 60").select(F.explode(prefixes).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("through"))


def closing_titles(tails_: DataFrame, least: int = 3) -> DataFrame:
    """(closing): texts of a last cue that at least ``least`` files share and that go on in no more files than end with
    them. A cut leaves one of a cue's many beginnings, so among the last cues that begin with a fragment few are the
    fragment itself, however many files there are."""
    shared = stage_table(tails_.where("closing != ''").groupBy("closing").agg(F.count("*").alias("files")).where(F.col("files") >= least))
    begins = F.transform(F.sequence(F.lit(1), F.length("opening") - 1), lambda i: F.col("opening").substr(F.lit(1), i))
    longer = tails_.where("length(opening) > 1").select(F.explode(begins).alias("closing"))
    longer = longer.where(may_hold(shared.select(F.col("closing").alias("key")))(F.xxhash64("closing"))).groupBy("closing").agg(F.count("*").alias("longer"))
    return shared.join(longer, "closing", "left").where("coalesce(longer, 0) <= files").select("closing")


def usual_limits(tails_: DataFrame, least: int = 4, times: float = 8.0, beside: int = 40) -> DataFrame:
    """(source, unit, size, marked): lengths at which far more files of a source end than at the ``beside`` lengths
    on either side; marked if most of them carry a mark. Most files at a limit must break off or carry a mark. One row for each source and length is aggregated first."""
    sizes = tails_.where("not padded and source is not null").select("source", "mark", (F.col("mark") | ~F.col("closed") | (F.col("structure") != "")).alias("open"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x"))
    counts = sizes.select("source", "mark", "open", "x.unit", "x.size").groupBy("source", "unit", "size").agg(F.count("*").alias("n"), F.sum(F.col("mark").cast("long")).alias("marks"), F.sum(F.col("open").cast("long")).alias("open"))
    from pyspark.sql import Window

    around = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-beside, beside)
    return (
        counts.withColumn("near", F.sum("n").over(around))
        .where((F.col("n") >= least) & (F.col("n") >= times * (F.col("near") - F.col("n") + 1) / (2 * beside)) & (F.col("n") * 4 >= F.col("near") - F.col("n")) & (F.col("open") * 2 > F.col("n")))
        .select("source", "unit", "size", (F.col("marks") * 2 > F.col("n")).alias("marked"))
    )


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", declared: str = "n_chars") -> DataFrame:
    """(key, source, reasons): every text found cut, with what tells so."""
    ends, words = scanned(df, key, text, source, declared)
    words = stage_table(words)
    wanted = ends.where("word is not null").select(F.col("word").alias("node")).distinct()
    nodes = trie(words).join(wanted, "node", "left_semi").withColumnRenamed("node", "word")
    known = words.join(wanted.withColumnRenamed("node", "word"), "word", "left_semi")
    openers = words.where("n >= 3 and penult >= 0.15 * n").select(F.col("word").alias("before"), F.lit(True).alias("credit"))  # words that close with a name
    closings = closing_titles(ends).select("closing", F.lit(True).alias("usual"))
    limits = usual_limits(ends)
    at = limits.groupBy("source", F.when(F.col("unit") == "chars", F.col("size")).alias("at_chars"), F.when(F.col("unit") == "bytes", F.col("size")).alias("at_bytes")).agg(F.max("marked").alias("marked"))
    by_chars = at.where("at_chars is not null").select("source", F.col("at_chars").alias("chars"), F.col("marked").alias("chars_marked"))
    by_bytes = at.where("at_bytes is not null").select("source", F.explode(F.sequence(F.col("at_bytes") - 3, F.col("at_bytes"))).alias("bytes"), "at_bytes", F.col("marked").alias("bytes_marked")).groupBy("source", "bytes").agg(F.max("at_bytes").alias("at_bytes"), F.max("bytes_marked").alias("bytes_marked"))
    all_ = (
        ends.join(nodes, "word", "left")
        .join(known, "word", "left")
        .join(openers, "before", "left")
        .join(closings, "closing", "left")
        .join(by_chars, ["source", "chars"], "left")
        .join(by_bytes, ["source", "bytes"], "left")
        .withColumn("through", F.coalesce("through", F.lit(0)))
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    whole = F.col("usual").isNotNull() | F.col("credit").isNotNull()  # closing titles and credits
    spaced = ~F.col("word").rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]")  # in scripts without spaces a token is a clause
    prefix = ~whole & (spaced | ~F.col("mark")) & (F.col("through") >= 3) & ((F.col("n") == 0) | (F.col("n") * 50 <= F.col("through"))) & F.col("word").isNotNull()
    at_chars = F.col("chars_marked").isNotNull() & (~F.col("chars_marked") | F.col("mark"))
    at_bytes = F.col("bytes_marked").isNotNull() & (~F.col("bytes_marked") | F.col("mark")) & ((F.col("bytes") == F.col("at_bytes")) | ((F.col("bytes") > F.col("chars")) & ~F.col("closed")))
    limit = ~F.col("padded") & (at_chars | at_bytes)
    beyond = (F.col("declared") - F.col("chars") > 2) & (F.col("declared") > F.col("bytes") + 2)
    beyond = beyond | ((F.col("declared") - F.col("chars") > 2) & (F.col("declared") != F.col("bytes")) & (F.col("declared") > F.col("chars") * 1.02) & ~F.col("closed"))
    unfinished = ~whole & (F.col("closes") >= 0.6) & ~F.col("mark") & ~F.col("closed") & (((F.col("ends_in") == "word") & (F.coalesce("bare", F.lit(0)) >= 5) & (F.col("final") <= 0.35 * F.col("bare"))) | (F.col("ends_in") == "comma"))
    rules = [
        F.when(F.col("structure") != "", F.concat(F.lit("breaks off in "), "structure")),
        F.when(prefix, F.lit("final token is a prefix of words")),
        F.when(limit, F.lit("length is a limit of the source")),
        F.when(beyond, F.lit("declared longer")),
        F.when(unfinished, F.lit("sentence unfinished")),
    ]
    return all_.withColumn("reasons", F.array_compact(F.array(*rules))).where(F.size("reasons") > 0).select(F.col("doc").cast(dict(df.dtypes)[key]).alias(key), "source", "reasons", "chars", "bytes", "declared", "mark", "word", "structure")


def truncation_by_source(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", declared: str = "n_chars") -> DataFrame:
    """(source, documents, truncated, share) for each source in lower case without outer space, null as one source."""
    named = df.groupBy(F.lower(F.trim(source)).alias("source")).agg(F.count("*").alias("documents"))
    cut = truncated(df, key, text, source, declared).select(key).distinct()
    cut = df.join(cut, key, "left_semi").groupBy(F.lower(F.trim(source)).alias("source")).agg(F.count("*").alias("truncated"))
    both = named.alias("a").join(cut.alias("b"), F.expr("a.source <=> b.source"), "left")
    return both.select("a.source", "documents", F.coalesce("truncated", F.lit(0)).alias("truncated")).withColumn("share", F.round(F.col("truncated") / F.col("documents"), 6))
