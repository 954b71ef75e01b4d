"""Near-duplicate texts with small edits, as a similarity join over word shingles.

Method: parity-sketch join. The shingles of a text are hashed into the cells of a sketch, and each cell holds the
XOR of its shingles, so the cells in which two sketches differ are at most the shingles in which the texts
differ. Texts of one size band use the same number of cells; two texts alike to the threshold differ in few
enough shingles that cells stay equal, and equal cells (pigeonholes) make candidates. A bit sketch, whose
Hamming distance bounds the symmetric difference from below, drops candidates, and the rest are verified on
their shingle sets.

A text emits all cells of its own band, and those of the next one if a partner there can be alike enough. The cells
of a band are laid out so often (``layout``) that two texts alike to exactly the threshold are expected to have 12
equal cells with enough shingles in them, so that the chance of none is about 6e-6 there and falls
steeply above it. Cells with a single shingle count only for small texts. A text of at most 2 ** TINY_BAND
shingles also meets others in its least hashes, as many as two alike texts must have one of in common (prefix
filter), which is exact where both texts are that small.

In a pigeonhole of up to ``hot`` texts all meet. In a fuller one they meet with their bit sketches at hand, so
only pairs that the sketches allow leave the task. One with more than ``most_met`` texts is dealt into blocks, and
every two blocks of it meet likewise, so no pair of a pigeonhole goes unseen, however full it is. Pigeonholes that a
64th of the texts shows to hold a good part of all are dealt at once, without passing through one task; that is
where they meet, not whether.

Texts with the same shingle set are one class; only one of each class is joined.

Defined results: a text with fewer words than a shingle has no shingle and takes part in no pair; null likewise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.flat import chunks, code_points, equal_runs, may_hold, mix, ragged, runs, span_hash, whole_runs
from scriptorium.llm.tokenizer import strings
from scriptorium.session import default_parallelism, stage_table

SMALL_BAND = 6  # bands up to 2 ** 6 shingles use fine cells, in which a single shingle counts
EXPECTED = 12  # equal cells of two texts alike to exactly the threshold
TINY_BAND = 5  # texts up to 2 ** 5 shingles also meet in their least shingles
FEATURES = "key string, n int, h1 long, h2 long, cells array<long>, sketch binary"


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and their offsets."""
    points, offsets = code_points([t.lower() for t in texts])
    start, end = runs(((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57)), offsets)
    word = span_hash(points, start, end)
    owner = np.searchsorted(offsets, start, "right") - 1
    count = len(word) - words + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(owner[words - 1 :] == owner[:count])
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            value = mix(value * np.uint64(5) + word[at + k])
    owner = owner[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    value, owner = value[first], owner[first]
    return value, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))]


def band_of(n: np.ndarray) -> np.ndarray:
    """Band b holds the sizes above 2 ** (b - 1) up to 2 ** b."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def expected_matches(n: float, cells: int, threshold: float, fine: bool) -> float:
    """Equal cells with enough shingles, of two texts of ``n`` shingles alike to exactly the threshold."""
    apart, common = 2 * n * (1 - threshold) / (1 + threshold), 2 * n * threshold / (1 + threshold) / cells
    return cells * math.exp(-apart / cells) * (1 - math.exp(-common) * (1 if fine else 1 + common))


@cache
def layout(band: int, threshold: float) -> tuple[int, int]:
    """Number of cells of a band and how many times its shingles are dealt into them."""
    size, fine = 2**band, band <= SMALL_BAND
    cells = max(int(size / (1.5 if fine else 3)), 1)
    while cells > 256 and expected_matches(size, cells * 9 // 10, threshold, fine) >= EXPECTED:
        cells = cells * 9 // 10
    if band <= TINY_BAND:
        return cells, 1
    least = min(expected_matches(n, cells, threshold, fine) for n in (size // 2 + 1, size))
    return cells, min(max(math.ceil(EXPECTED / max(least, 1e-9)), 1), size)


def parity_cells(value: np.ndarray, offsets: np.ndarray, band: np.ndarray, use: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, pigeonhole) of the used texts' cells: XOR of the cell's shingles, mixed with the cell and the band."""
    n = np.diff(offsets)
    cells, times = (np.array([layout(b, threshold)[i] for b in range(int(band.max(initial=0)) + 1)], np.int64) for i in (0, 1))
    texts, holes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for turn in range(int(times[band[use]].max(initial=0))):
        used = np.flatnonzero(use & (times[band] > turn))
        owner, shingle = np.repeat(used, n[used]), value[ragged(offsets[:-1][used], n[used])]
        spot = (mix(shingle + np.uint64(turn)) if turn else shingle) >> np.uint64(20)
        cell = (spot % cells[band[owner]].astype(np.uint64)).astype(np.int64)
        key = (owner << 32) | cell
        order = np.argsort(key, kind="stable")
        start, end = equal_runs(key[order])
        if not len(start):
            continue
        parity = np.bitwise_xor.reduceat(mix(shingle[order]), start)
        head = order[start]
        good = (end - start >= 2) | (band[owner[head]] <= SMALL_BAND)
        text, at = owner[head][good], cell[head][good]
        with np.errstate(over="ignore"):
            texts.append(text)
            holes.append(mix(parity[good] + mix(((band[text] * 4096 + turn << 32) + at + 1).astype(np.uint64))))
    return np.concatenate(texts), np.concatenate(holes)


def prefix_holes(value: np.ndarray, offsets: np.ndarray, use: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, pigeonhole) of the used texts' least shingles: of n all but ceil(threshold * n) - 1, since texts alike to the
    threshold have at least ceil(threshold * n) in common and so the least of these among the first of both."""
    n = np.diff(offsets)
    count = np.where(use, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
    at = ragged(offsets[:-1], np.minimum(count, n))
    return np.repeat(np.arange(len(n)), np.minimum(count, n)), mix(value[at] ^ np.uint64(0x3C3C3C3C3C3C3C3C))


def bit_sketch(value: np.ndarray, n: int) -> bytes:
    """Parity of the shingles at each of 2n or more bits (a power of two, 64 at least)."""
    bits = 1 << max(6, int(2 * n - 1).bit_length())
    counts = np.bincount((mix(value) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits after folding the longer sketch to the length of the shorter."""
    if len(a) > len(b):
        a, b = b, a
    wide = np.frombuffer(b, np.uint8)
    while len(wide) > len(a):
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return int(np.bitwise_count(wide ^ np.frombuffer(a, np.uint8)).sum())


def features(df: DataFrame, key: str, text: str, words: int, threshold: float) -> DataFrame:
    """One row for each text with a shingle: size, hashes of the set, pigeonholes and bit sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in chunks(texts):
                value, offsets = shingle_sets(texts[a:b], words)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                band = band_of(n)
                with np.errstate(over="ignore"):
                    h1 = np.add.reduceat(mix(value), offsets[full])
                    h2 = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[full])
                parts = [parity_cells(value, offsets, band, n > 0, threshold), parity_cells(value, offsets, band + 1, n >= threshold * (np.exp2(band) + 1), threshold), prefix_holes(value, offsets, (n > 0) & (band <= TINY_BAND), threshold)]
                owner, hole = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(owner, kind="stable")
                counts = np.bincount(owner, minlength=b - a)[full]
                cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(hole[order].view(np.int64)))
                sketches = [bit_sketch(value[offsets[i] : offsets[i + 1]], int(n[i])) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(full)), pa.array(n[full].astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), cells, pa.array(sketches, pa.binary())],
                    ["key", "n", "h1", "h2", "cells", "sketch"],
                )

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and length(text) > 0").mapInArrow(make, FEATURES)


def meet(holes: DataFrame, threshold: float, hot: int, parts: int) -> DataFrame:
    """(a, b, crowded): pairs of texts of one pigeonhole that the sizes allow; of a crowded one (text, hole) instead."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "hole"):
            hole, text, n = (table.column(c).to_numpy() for c in ("hole", "text", "n"))
            order = np.lexsort((text, n, hole))
            order = order[np.r_[True, (hole[order][1:] != hole[order][:-1]) | (text[order][1:] != text[order][:-1])]]
            hole, text, n = hole[order], text[order], n[order]
            start, end = equal_runs(hole)
            size = end - start
            crowded = np.flatnonzero(np.repeat(size > hot, size))
            keep = (size > 1) & (size <= hot)
            start, end = start[keep], end[keep]
            # each text with those after it in its pigeonhole
            last = np.repeat(end, end - start)
            here = ragged(start, end - start)
            reach = last - here - 1
            left, right = np.repeat(here, reach), ragged(here + 1, reach)
            good = (n[left] >= threshold * n[right]) & (text[left] != text[right])
            a, b = text[left[good]], text[right[good]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.minimum(a, b), text[crowded]]), pa.array(np.r_[np.maximum(a, b), hole[crowded]]), pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(crowded), bool)])], ["a", "b", "crowded"]
            )

    return holes.repartition(parts, "hole").sortWithinPartitions("hole").mapInArrow(pairs, "a long, b long, crowded boolean")


def narrow_meet(holes: DataFrame, threshold: float, hot: int | None, parts: int, block: int = 512) -> DataFrame:
    """As :func:`meet` for rows that carry their bit sketch: only pairs whose sketches allow the threshold come out.
    Rows with a ``half`` (0 or 1) meet those of the other half of their pigeonhole only, if it has both."""
    most = (1 - threshold) / (1 + threshold)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "hole"):
            hole, text, n = (table.column(c).to_numpy() for c in ("hole", "text", "n"))
            half = table.column("half").to_numpy() if "half" in table.column_names else np.zeros(len(hole), np.int32)
            order = np.lexsort((text, half, hole))
            order = order[np.r_[True, (hole[order][1:] != hole[order][:-1]) | (text[order][1:] != text[order][:-1])]]
            hole, text, n, half = hole[order], text[order], n[order], half[order]
            sketch = table.column("sketch").take(pa.array(order))
            for a, b in zip(*equal_runs(hole)):
                if hot is not None and b - a > hot:
                    yield pa.RecordBatch.from_arrays([pa.array(text[a:b]), pa.array(hole[a:b]), pa.array(np.ones(b - a, bool))], ["a", "b", "crowded"])
                    continue
                for one, other in allowed(text[a:b], n[a:b], half[a:b], sketch.slice(a, b - a).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(np.zeros(len(one), bool))], ["a", "b", "crowded"])

    def allowed(text: np.ndarray, n: np.ndarray, half: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        widths, bits = stack(sketches)
        total, middle = len(text), int(np.searchsorted(half, 1))
        crossed = 0 < middle < total
        for i in range(0, middle if crossed else total, block):
            for j in range(middle if crossed else i, total, block):
                x, y = slice(i, min(i + block, middle if crossed else total)), slice(j, min(j + block, total))
                left, right = n[x][:, None], n[y][None, :]
                good = np.minimum(left, right) >= threshold * np.maximum(left, right)
                if not crossed:
                    good &= text[x][:, None] < text[y][None, :]
                u, v = np.nonzero(good)
                shared = np.minimum(widths[u + i], widths[v + j])
                far = np.zeros(len(u), np.int64)
                for width, rows in bits.items():  # each pair at the shorter of its two lengths
                    at = np.flatnonzero(shared == width)
                    far[at] = np.bitwise_count(rows[u[at] + i] ^ rows[v[at] + j]).sum(1, dtype=np.int64)
                close = far <= most * (n[x][u] + n[y][v]) + 1e-9
                if close.any():
                    yield text[x][u[close]], text[y][v[close]]

    return holes.repartition(parts, "hole").sortWithinPartitions("hole").mapInArrow(pairs, "a long, b long, crowded boolean")


def stack(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Length of each sketch in 64-bit words, and for each length that occurs all sketches that long or longer,
    folded to it, in their places (others are zero there)."""
    widths = np.array([len(x) // 8 for x in sketches])
    folded: dict[int, np.ndarray] = {}
    for width in sorted(set(widths.tolist())):
        rows = np.zeros((len(sketches), width), np.uint64)
        for k, sketch in enumerate(sketches):
            words = np.frombuffer(sketch, np.uint64)
            while len(words) > width:
                words = words[: len(words) // 2] ^ words[len(words) // 2 :]
            if len(words) == width:
                rows[k] = words
        folded[width] = rows
    return widths, folded


def dealt(fullest: DataFrame, carried: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(hole, text, half, n, sketch): overfull pigeonholes dealt into blocks of about ``block`` texts, as one pigeonhole
    for each block and each two blocks; and the number of its rows."""
    counts = stage_table(fullest.groupBy("hole").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("texts")))
    rows = counts.agg(F.sum(F.col("texts") * F.col("blocks"))).first()[0] or 0
    own = fullest.join(counts.select("hole", "blocks"), "hole").withColumn("own", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    each = own.select("text", "hole", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spots = each.select(F.xxhash64("hole", F.least("own", "other"), F.greatest("own", "other")).alias("hole"), "text", (F.col("own") > F.col("other")).cast("int").alias("half"))
    return spots.join(carried, "text"), rows


def classes(df: DataFrame, key: str = "id", text: str = "text", words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, heads), staged. Rows have key, h1, h2, n and cells; heads one row for each class of equal shingle sets:
    class (its least key), h1, h2, n and sketch."""
    made = stage_table(features(df, key, text, words, threshold))
    heads = made.groupBy("h1", "h2").agg(F.min("key").alias("class"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return made, stage_table(heads)


def members(made: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, class)."""
    return made.select("key", "h1", "h2").join(heads.select("h1", "h2", "class"), ["h1", "h2"]).select("key", "class")


def spread_holes(made: DataFrame, fullest: np.ndarray, those: bool = False) -> DataFrame:
    """(hole, text, n): pigeonholes of each text but for the fullest ones, or only these. Copies have equal ones, which
    each batch passes on once, so a group of copies of any size adds few rows to a pigeonhole."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(first)))
            counts = np.diff(batch.column(2).offsets.to_numpy())
            holes = batch.column(2).flatten().to_numpy()
            use = np.isin(holes, fullest) if len(fullest) else np.zeros(len(holes), bool)
            use = use if those else ~use
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (holes, np.repeat(batch.column(0).to_numpy(), counts), np.repeat(batch.column(1).to_numpy(), counts))], ["hole", "text", "n"])

    return made.select("h1", "n", "cells").mapInArrow(explode, "hole long, text long, n int")


def fullest_holes(made: DataFrame, share: int = 64, part: int = 4096, least: int = 16) -> np.ndarray:
    """Pigeonholes that hold a ``part``-th or more of the texts with h1 divisible by ``share``, and ``least`` of them: at
    most ``part`` times the pigeonholes of a text, whatever the number of texts."""
    some = made.where(F.pmod("h1", F.lit(share)) == 0)
    most = max(least, some.select("h1").distinct().count() // part)
    counted = spread_holes(some, np.zeros(0, np.int64)).select("hole", "text").distinct().groupBy("hole").count().where(F.col("count") >= most)
    return np.sort(counted.select("hole").toArrow().column(0).to_numpy())


def similar_classes(made: DataFrame, heads: DataFrame, df: DataFrame, key: str = "id", text: str = "text", words: int = 5, threshold: float = 0.8, hot: int = 4, most_met: int = 512) -> DataFrame:
    """(class_a, class_b, similarity): every two classes alike to the threshold, the smaller first."""
    parts = default_parallelism(df.sparkSession)
    full = fullest_holes(made)
    met = stage_table(meet(spread_holes(made, full), threshold, hot, parts))
    pairs = met.where("not crowded").select("a", "b")
    carried = heads.select(F.col("h1").alias("text"), "sketch", "n")
    crowded = met.where("crowded").select(F.col("a").alias("text"), F.col("b").alias("hole"))
    again = stage_table(narrow_meet(crowded.join(carried, "text"), threshold, most_met, parts))
    fullest = again.where("crowded").select(F.col("a").alias("text"), F.col("b").alias("hole"))
    if len(full):
        fullest = stage_table(fullest.unionByName(spread_holes(made, full, True).select("text", "hole").distinct()))
    blocks, rows = dealt(fullest, carried, 4 * most_met)
    for more in (again, narrow_meet(blocks, threshold, None, max(parts, rows // 100_000))):
        pairs = pairs.unionByName(more.where("not crowded").select("a", "b"))
    sketches = heads.select("h1", "n", "sketch", F.col("class").alias("key"))

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("h1").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"), F.col("key").alias(f"key_{name}"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b"))
            most = (1 - threshold) / (1 + threshold)
            good = [hamming(a, b) <= most * (x + y) + 1e-9 for a, b, x, y in zip(s_a, s_b, n_a, n_b)]
            key_a, key_b = (batch.column(batch.schema.get_field_index(c)).filter(pa.array(good)) for c in ("key_a", "key_b"))
            yield pa.RecordBatch.from_arrays([key_a, key_b], ["key_a", "key_b"])

    close = pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(narrow, "key_a string, key_b string")
    close = stage_table(close)
    texts = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    wanted = close.select(F.col("key_a").alias("key")).unionByName(close.select(F.col("key_b").alias("key"))).distinct()
    texts = texts.where(may_hold(wanted)(F.xxhash64("key"))).join(wanted, "key", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = strings(batch.column(2)), strings(batch.column(3))
            for i, j in chunks([x + y for x, y in zip(left, right)]):
                a, a_at = shingle_sets(left[i:j], words)
                b, b_at = shingle_sets(right[i:j], words)
                score = np.zeros(j - i)
                for k in range(j - i):
                    x, y = a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]]
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    score[k] = both / max(len(x) + len(y) - both, 1)
                good = pa.array(score >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(good), batch.column(1).slice(i, j - i).filter(good), pa.array(score).filter(good)], ["key_a", "key_b", "similarity"])

    checked = (
        close.join(texts.withColumnRenamed("key", "key_a").withColumnRenamed("text", "text_a"), "key_a")
        .join(texts.withColumnRenamed("key", "key_b").withColumnRenamed("text", "text_b"), "key_b")
        .select("key_a", "key_b", "text_a", "text_b")
        .mapInArrow(verify, "key_a string, key_b string, similarity double")
    )
    return checked.groupBy(F.least("key_a", "key_b").alias("class_a"), F.greatest("key_a", "key_b").alias("class_b")).agg(F.max("similarity").alias("similarity"))


def near_duplicate_pairs(df: DataFrame, key: str = "id", text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key_a, key_b): all pairs of different rows, copies expanded. The output itself grows with copies squared;
    use :func:`near_duplicate_groups` where copies may be many."""
    made, heads = classes(df, key, text, words, threshold)
    links = similar_classes(made, heads, df, key, text, words, threshold).select("class_a", "class_b")
    member = stage_table(members(made, heads))
    crossed = links.join(member.select(F.col("class").alias("class_a"), F.col("key").alias("x")), "class_a").join(member.select(F.col("class").alias("class_b"), F.col("key").alias("y")), "class_b").select("x", "y")
    copied = member.groupBy("class").count().where("count > 1").select("class")
    inside = member.join(copied, "class", "left_semi")
    copies = inside.select("class", F.col("key").alias("x")).join(inside.select("class", F.col("key").alias("y")), "class").where("x < y").select("x", "y")
    return crossed.unionByName(copies).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).where(f"{key}_a != {key}_b").distinct()


def near_duplicate_groups(df: DataFrame, key: str = "id", text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each text with a shingle: its class of equal shingle sets, the number of classes linked to it,
    and its group, the least key that links lead to."""
    from scriptorium.operators.components import connected_components

    made, heads = classes(df, key, text, words, threshold)
    links = stage_table(similar_classes(made, heads, df, key, text, words, threshold).select("class_a", "class_b"))
    ends = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    count = ends.groupBy(F.col("class_a").alias("class")).agg(F.count("*").alias("links"))
    groups = connected_components(links, "class_a", "class_b").select(F.col("node").alias("class"), F.col("component").alias("group"))
    return (
        members(made, heads)
        .join(count, "class", "left")
        .join(groups, "class", "left")
        .select(F.col("key").alias(key), "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))
    )
