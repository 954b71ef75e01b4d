"""P5: long exact spans shared between records.

Method: suffix automata of reference shards, with documents streamed for matching statistics. One automaton of
the whole corpus streamed by every document would cost corpus x shards, so the shards are routed first: every
stretch of ``least`` characters holds an anchor (the smallest window hash of its neighbourhood), equal
stretches hold equal anchors, and anchors that stand in the same set of rows form one shard. A shard holds the
neighbourhoods of its anchors in its rows, equal ones once, and each is streamed through the shard's automaton.
Everything that can't be in a shared span is removed before any automaton is built.

An automaton holds at most about ``automaton_chars`` characters. A larger shard is dealt into blocks, each with an
automaton of its own, and every piece of the shard is streamed through all of them. A passage that stands in many
rows is no hot group: anchors, rows of an anchor and equal pieces meet in aggregations, which combine before they
shuffle, and rows come back by joins with the results.

Defined results: null, empty and short texts have no shared span; rows that repeat an id count as that one
row; a passage repeated inside one row alone isn't shared; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.automaton import SuffixAutomaton
from scriptorium.llm.flat import TOP, chunks, code_points, equal_runs, may_hold, merge_spans, slide, whole_runs, window_hash
from scriptorium.llm.tokenizer import strings
from scriptorium.session import default_parallelism, stage_table


def anchors_of(texts: list[str], least: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors: window hashes that are least in some neighbourhood."""
    points, offsets = code_points(texts)
    n, width = len(points), least - size + 1
    if n < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes = window_hash(points, size)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    whole = owner[: len(hashes)] == owner[size - 1 :]
    hashes[~whole] = TOP
    floor = slide(hashes, width, np.minimum)
    ceiling = slide(np.concatenate([np.zeros(width - 1, np.uint64), floor, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    chosen = (hashes == ceiling) & whole
    # a long run of one repeated hash (periodic text) keeps every size-th of its anchors and the edges
    same = np.zeros(len(hashes), bool)
    same[1:-1] = (hashes[1:-1] == hashes[:-2]) & (hashes[1:-1] == hashes[2:])
    at = np.flatnonzero(chosen & (~same | (np.arange(len(hashes)) % size == 0)))
    text = owner[at]
    return text, at - offsets[text], hashes[at]


def anchor_table(rows: DataFrame, least: int, size: int) -> DataFrame:
    """(hash, rid, at, first): anchors of each row; ``first`` is true once for each anchor of a row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rid = strings(batch.column(1)), batch.column(0).to_numpy()
            for a, b in chunks(texts):
                owner, at, hashes = anchors_of(texts[a:b], least, size)
                order = np.lexsort((hashes, owner))
                owner, at, hashes = owner[order], at[order], hashes[order]
                first = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(owner)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(rid[a:b][owner]), pa.array(at.astype(np.int32)), pa.array(first)], ["hash", "rid", "at", "first"])

    return rows.select("rid", "text").mapInArrow(find, "hash long, rid long, at int, first boolean")


def pieces_of(marked: DataFrame, least: int, reach: int) -> DataFrame:
    """(shard, key, start, piece): neighbourhoods of the anchors of a row, for each shard that the row is in."""
    schema = pa.schema([("shard", pa.int64()), ("key", pa.string()), ("start", pa.int32()), ("piece", pa.string())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            size = 0
            for name, value, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shards = marks.values.field(0).to_numpy()
                at = marks.values.field(1).to_numpy().astype(np.int64)
                order = np.argsort(shards, kind="stable")
                shards, at = shards[order], at[order]
                for a, b in zip(*equal_runs(shards)):
                    begins, ends = merge_spans(np.maximum(at[a:b] - reach, 0), np.minimum(at[a:b] + least, len(value)))
                    for s, e in zip(begins.tolist(), ends.tolist()):
                        if e - s >= least:
                            for column, x in zip(out, (int(shards[a]), name, s, value[s:e])):
                                column.append(x)
                            size += e - s
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out, size = [[], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return marked.select("key", "text", "marks").mapInArrow(gather, "shard long, key string, start int, piece string")


def streamed(units: DataFrame, least: int, parts: int) -> DataFrame:
    """(shard, ph, s, e): shared stretches of the pieces; a unit's ``reference`` rows make its automaton, through which
    its rows of a single owner are streamed. Tasks hold one unit at a time."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            unit, shard, ph, low, high = (table.column(c).to_numpy() for c in ("unit", "shard", "ph", "low", "high"))
            reference, piece = table.column("reference").to_pylist(), table.column("piece").to_pylist()
            out: list[tuple[int, int, int]] = []
            for a, b in zip(*equal_runs(unit)):
                known = [i for i in range(a, b) if reference[i]]
                out += [(i, 0, len(piece[i])) for i in known if low[i] != high[i]]  # a copy's whole piece is shared
                lonely = [i for i in range(a, b) if low[i] == high[i]]
                if not lonely or not known or (len(known) == 1 and lonely == known):
                    continue
                owners = np.unique(np.concatenate([low[a:b], high[a:b]]))
                least_owner, most_owner = np.searchsorted(owners, low[a:b]), np.searchsorted(owners, high[a:b])
                machine = SuffixAutomaton([piece[i] for i in known], [int(least_owner[i - a]) for i in known], [int(most_owner[i - a]) for i in known])
                for i in lonely:
                    out += [(i, s, e) for s, e in machine.foreign_spans(piece[i], int(least_owner[i - a]), least)]
            at = np.array([x[0] for x in out], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(ph[at]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], ["shard", "ph", "s", "e"])

    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(resolve, "shard long, ph long, s int, e int")


def dealt_units(pieces: DataFrame, automaton_chars: int) -> DataFrame:
    """(unit, shard, ph, piece, low, high, reference): a shard is one unit, or, if it has more characters than an
    automaton may hold, one for each block of its pieces, to which the other pieces of one owner come as well."""
    sizes = pieces.groupBy("shard").agg(F.sum(F.length("piece")).alias("chars"), F.count("*").alias("n"), F.max(F.col("low") != F.col("high")).alias("copied"))
    # a shard with a single piece of a single owner has nothing to tell
    blocks = sizes.where("n > 1 or copied").select("shard", F.ceil(F.col("chars") / automaton_chars).cast("int").alias("blocks"))
    each = pieces.join(blocks, "shard").withColumn("own", F.pmod("ph", F.col("blocks")).cast("int"))
    spread = each.withColumn("block", F.explode(F.when(F.col("low") == F.col("high"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    return spread.select(F.xxhash64("shard", "block").alias("unit"), "shard", "ph", "piece", "low", "high", (F.col("own") == F.col("block")).alias("reference"))


def shared_spans(df: DataFrame, key: str = "id", text: str = "text", least: int = 200, anchor: int = 64, automaton_chars: int = 100_000) -> DataFrame:
    """(key, spans array<struct<start,end>>, shared_chars) of each row with a shared span."""
    least, anchor = int(least), min(int(anchor), int(least))
    reach = least - anchor  # how far a stretch may begin before its anchor
    parts = default_parallelism(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") >= least)).withColumn("rid", F.xxhash64("key"))
    anchors = stage_table(anchor_table(rows, least, anchor))
    shared = stage_table(anchors.groupBy("hash").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low != high").select("hash"))
    kept = stage_table(anchors.where(may_hold(shared.select(F.col("hash").alias("key")))(F.xxhash64("hash"))).join(shared, "hash", "left_semi"))
    shard = kept.where("first").groupBy("hash").agg(F.bit_xor(F.xxhash64("rid")).alias("shard"))
    marks = kept.join(shard, "hash").groupBy("rid").agg(F.collect_list(F.struct("shard", "at")).alias("marks"))
    pieces = stage_table(pieces_of(marks.join(rows, "rid"), least, reach).withColumn("ph", F.xxhash64("piece")))
    owned = pieces.withColumn("rid", F.xxhash64("key"))
    distinct = stage_table(owned.groupBy("shard", "ph", "piece").agg(F.min("rid").alias("low"), F.max("rid").alias("high")))
    found = streamed(dealt_units(distinct, automaton_chars), least, parts).distinct()
    spans = found.join(pieces.select("shard", "ph", "key", "start"), ["shard", "ph"]).select("key", (F.col("start") + F.col("s")).alias("start"), (F.col("start") + F.col("e")).alias("end"))
    merged = spans.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    union = F.expr(
        """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (done, x) ->
             case when size(done) > 0 and x.start <= element_at(done, -1).end
                  then concat(slice(done, 1, size(done) - 1),
                              array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, x.end) as end)))
                  else concat(done, array(x)) end)"""
    )
    return merged.select(F.col("key").alias(key), union.alias("spans")).withColumn("shared_chars", F.expr("aggregate(spans, 0, (n, x) -> n + x.end - x.start)"))
