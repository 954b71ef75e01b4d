"""Splitting oversized texts at natural boundaries with overlap.

Method: a sparse-table range-maximum index over boundary strengths. Every place where a word ends before white
space is a boundary, the stronger the larger the unit that ends there (paragraph, line, sentence, word). The
strongest boundary of the permissible window is found in constant time, ties going to the right; the next piece
begins by stepping back ``overlap`` characters, moved on to a word start where there is one.

Defined results: null, empty and short texts give no piece; a stretch without any boundary is cut at the limit,
not inside a base character and its combining marks; characters are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.flat import code_points
from scriptorium.llm.tokenizer import WHITE_SPACE, strings

WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
# Marks that end a sentence, and marks that may follow them.
SENTENCE_ENDS = [ord(c) for c in ".!?…。！？"]
CLOSERS = [ord(c) for c in "\"')]»”’」"]
# Characters that a blank line may hold.
BLANK = [32, 9, 13, 12]


def is_in(points: np.ndarray, values: list[int]) -> np.ndarray:
    mask = np.zeros(len(points), bool)
    for value in values:
        mask |= points == value
    return mask


def paragraphs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of lines that aren't blank; the last line feed isn't part of a run."""
    n = len(points)
    feeds = np.flatnonzero(points == 10)
    start, end = np.r_[0, feeds + 1], np.r_[feeds, n]
    ink = np.r_[0, np.cumsum(~is_in(points, [*BLANK, 10]))]
    full = ink[end] > ink[start]
    first = np.flatnonzero(full & ~np.r_[False, full[:-1]])
    last = np.flatnonzero(full & ~np.r_[full[1:], False])
    return start[first], end[last]


class BoundaryIndex:
    """Boundaries of one text in order, their strengths, and a sparse table for range maxima over them."""

    def __init__(self, points: np.ndarray, limit: int) -> None:
        n = len(points)
        self.length = n
        space = is_in(points, WHITE_SPACE)
        feeds = np.r_[0, np.cumsum(points == 10)]
        self.paragraphs = paragraphs(points)
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1 if n else np.zeros(0, np.int64)  # cut before this character
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n else np.zeros(0, np.int64)
        follow = np.searchsorted(starts, ends)
        resume = np.r_[starts, n][follow]
        strength = np.full(len(ends), WORD, np.int8)
        before = points[ends - 1] if len(ends) else points[:0]
        second = points[np.maximum(ends - 2, 0)] if len(ends) else points[:0]
        strength[is_in(before, SENTENCE_ENDS) | (is_in(before, CLOSERS) & is_in(second, SENTENCE_ENDS))] = SENTENCE
        strength[feeds[resume] > feeds[ends]] = LINE
        closing = np.searchsorted(self.paragraphs[1], ends)
        strength[(feeds[resume] - feeds[ends] > 1) & (closing < len(self.paragraphs[1]))] = PARAGRAPH
        self.at, self.strength, self.starts = ends, strength, starts
        self.levels = [np.arange(len(ends))]
        span = 1
        while 2 * span <= min(len(ends), limit):
            left, right = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(strength[left] > strength[right], left, right))
            span *= 2

    def strongest(self, low: int, high: int) -> int | None:
        """The strongest boundary in [low, high], the last of equal ones; None if there is none."""
        a, b = int(np.searchsorted(self.at, low)), int(np.searchsorted(self.at, high, "right"))
        if a >= b:
            return None
        level = (b - a).bit_length() - 1
        left, right = int(self.levels[level][a]), int(self.levels[level][b - (1 << level)])
        return int(self.at[left if self.strength[left] > self.strength[right] else right])

    def word_start(self, low: int, high: int) -> int | None:
        """The first word start in [low, high]."""
        a = int(np.searchsorted(self.starts, low))
        return int(self.starts[a]) if a < len(self.starts) and self.starts[a] <= high else None


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of a text longer than ``limit``."""
    return cut(BoundaryIndex(code_points([text])[0], limit), text, limit, overlap)


def cut(index: BoundaryIndex, text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    start = 0
    while index.length - start > limit:
        end = index.strongest(start + max(limit // 2, overlap + 1), start + limit) or index.strongest(start + overlap + 1, start + limit)
        if end is None:
            end = start + limit
            while end > start + overlap + 1 and (unicodedata.combining(text[end]) or text[end] == "‍"):
                end -= 1
        out.append((start, end))
        back = max(end - overlap, start + 1)
        start = index.word_start(back, end - 1) or back
    out.append((start, index.length))
    return out


def check_sizes(limit: int, overlap: int) -> None:
    if limit < 2 or overlap < 0 or overlap > limit // 2:
        raise ValueError("limit must be 2 or more, overlap between 0 and half of it")


def split_oversized(df: DataFrame, key: str = "id", text: str = "text", section: str = "section", limit: int = 2_000, overlap: int = 200) -> DataFrame:
    """(key, section, piece_no, start, end, overlap, text): the pieces of each text longer than ``limit``; no shuffle."""
    check_sizes(limit, overlap)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, ends, shared, texts = [], [], [], [], [], []
            for row, value in enumerate(strings(batch.column(2))):
                done = 0
                for number, (a, b) in enumerate(pieces_of(value, limit, overlap), 1):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    ends.append(b)
                    shared.append(max(done - a, 0))
                    texts.append(value[a:b])
                    done = b
                if sum(map(len, texts)) > 4_000_000:
                    yield batch_of(batch, rows, numbers, starts, ends, shared, texts)
                    rows, numbers, starts, ends, shared, texts = [], [], [], [], [], []
            if rows:
                yield batch_of(batch, rows, numbers, starts, ends, shared, texts)

    def batch_of(batch: pa.RecordBatch, rows: list, *columns: list) -> pa.RecordBatch:
        take = pa.array(rows, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int32()) for c in columns[:-1]), pa.array(columns[-1], pa.string())],
            [key, section, "piece_no", "start", "end", "overlap", "text"],
        )

    kind = dict(df.dtypes)
    return (
        df.where(F.length(text) > limit)
        .select(key, section, text)
        .mapInArrow(split, f"`{key}` {kind[key]}, `{section}` {kind[section]}, piece_no int, start int, end int, overlap int, text string")
    )


def oversized_units(df: DataFrame, key: str = "id", text: str = "text", limit: int = 2_000, overlap: int = 200) -> DataFrame:
    """(key, para_no): 0 for each text that the splitter cuts, and the number of each paragraph that it would have to cut by
    itself, so that no paragraph boundary alone brings the text under the limit."""
    check_sizes(limit, overlap)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = [], []
            for row, value in enumerate(strings(batch.column(1))):
                points = code_points([value])[0]
                index = BoundaryIndex(points, limit)
                if len(cut(index, value, limit, overlap)) > 1:
                    rows.append(row)
                    numbers.append(0)
                ink = np.flatnonzero(~is_in(points, BLANK))
                for number, (a, b) in enumerate(zip(*index.paragraphs), 1):
                    if b - a > limit:
                        inside = ink[np.searchsorted(ink, a) : np.searchsorted(ink, b)]
                        if len(pieces_of(value[inside[0] : inside[-1] + 1], limit, overlap)) > 1:
                            rows.append(row)
                            numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32())], [key, "para_no"])

    return df.where(F.length(text) > limit).select(key, text).mapInArrow(units, f"`{key}` {dict(df.dtypes)[key]}, para_no int")
