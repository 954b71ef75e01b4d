"""Parent links to full hierarchies by tree contraction.

Links go from a node to the nodes it builds on; a root has no link. A round of contraction *rakes* the nodes that
nothing links to and *compresses* unary chains by splicing out nodes with a single link, no two neighbours in one
round. Every round is one job: it reads the links that are left and writes one table, in which the links of raked
nodes, those of spliced nodes and those that are left stand apart. Once at most ``block_links`` links are left, one
task contracts them to the end by the same two steps. What neither step can remove is the core: cycles, and what
can be reached from them. The recorded steps are undone in reverse; that gives each node its roots, depths, paths
and ancestors, and tells which spliced nodes lie on a cycle.

A core of more than ``block_links`` links stays distributed: it is solved by relaxation, and its strong components
by colouring, in rounds that grow with its diameter.

Nothing is collected on the driver. A round takes about half of a forest; a graph of nodes with several links each loses a
layer of leaves a round.

Defined results: links to a number that has no row, null numbers and repeated links are ignored; a node may link
to itself and is then on a cycle; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.contraction import Block
from scriptorium.session import stage_path, stage_table

BLOCK_LINKS = 8_192
LEFT, RAKED, SPLICED, INTO, LOOP = range(5)


def links_of(current: DataFrame, key: str = "rfc_number", lists: tuple[str, ...] = ("updates", "obsoletes")) -> DataFrame:
    """(src, dst): one row for each node and each number in its lists that has a row itself."""
    every = F.concat(*(F.coalesce(c, F.array().cast("array<int>")) for c in lists))
    links = current.select(F.col(key).alias("src"), F.explode(F.array_distinct(every)).alias("dst")).where("src is not null and dst is not null").distinct()
    return links.join(current.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def least(df: DataFrame, *by: str, via: str | None = None, cost: str = "w") -> DataFrame:
    """The least cost of each key, and with ``via`` the least nodes between at that cost."""
    if via is None:
        return df.groupBy(*by).agg(F.min(cost).alias(cost))
    return df.groupBy(*by).agg(F.min(F.struct(cost, via)).alias("_x")).select(*by, f"_x.{cost}", f"_x.{via}")


class Contraction:
    """Record of a contraction of links (src, dst): ``rounds`` of removed links, and ``rest``, what was left.

    A link has its number of original links ``w``, whether ``dst`` is a root (``top``), and, with ``nodes_between``,
    the nodes it stands for (``via``), so that paths can be told.
    """

    def __init__(self, links: DataFrame, block_links: int = BLOCK_LINKS, nodes_between: bool = False) -> None:
        self.via = "via" if nodes_between else None
        extra = [F.array().cast("array<int>").alias("via")] if nodes_between else []
        self.columns = ["src", "dst", "w", "top", *(["via"] if nodes_between else [])]
        built = links.select(F.col("src").alias("dst")).distinct().withColumn("_built", F.lit(True))
        first = links.join(built, "dst", "left").select(F.when(F.col("src") == F.col("dst"), LOOP).otherwise(LEFT).alias("part"), "src", "dst", F.lit(1).alias("w"), F.col("_built").isNull().alias("top"), *extra)
        self.first = stage_table(first, ("part",))
        self.rounds: list[DataFrame] = []
        left, turn = self.left().count(), 0
        while left > block_links:
            self.rounds.append(stage_table(self.round(self.left(), turn), ("part",)))
            now = self.left().count()
            if now == left:
                break
            left, turn = now, turn + 1
        self.in_block = left <= block_links
        self.links_left = left

    def part(self, at: int, kind: int) -> DataFrame:
        return self.rounds[at].where(F.col("part") == kind).select(*self.columns)

    def left(self) -> DataFrame:
        return (self.rounds[-1] if self.rounds else self.first).where(F.col("part") == LEFT).select(*self.columns)

    def round(self, edges: DataFrame, turn: int) -> DataFrame:
        """(part, link): the fate of every link in this round."""
        carried = ["w", "top", *(["via"] if self.via else [])]
        sides = edges.select(F.col("src").alias("node"), F.lit(1).alias("outs"), F.lit(0).alias("ins"), F.col("dst").alias("to"), *carried).unionByName(
            edges.select(F.col("dst").alias("node"), F.lit(0).alias("outs"), F.lit(1).alias("ins")), allowMissingColumns=True
        )
        nodes = sides.groupBy("node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"), F.min("to").alias("to"), *(F.min(c).alias(c) for c in carried)).where("outs > 0")
        unary = nodes.where("outs = 1 and ins > 0").drop("outs", "ins")
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 0
        # of two unary neighbours at most the one with a coin before one without goes
        facing = unary.select(F.col("node").alias("to"), F.lit(True).alias("_unary"))
        spliced = unary.where(coin("node")).join(facing, "to", "left").where(F.col("_unary").isNull() | ~coin("to"))
        gone = nodes.where("ins = 0").select(F.col("node").alias("src"), F.lit(RAKED).alias("fate")).unionByName(spliced.select(F.col("node").alias("src"), F.lit(SPLICED).alias("fate")))
        over = spliced.select(F.col("node").alias("dst"), F.col("to").alias("_to"), *(F.col(c).alias(f"_{c}") for c in carried))
        met = edges.join(gone, "src", "left").join(over, "dst", "left")
        plain = [F.col(c) for c in self.columns[2:]]
        joined = [(F.col("w") + F.col("_w")).alias("w"), F.col("_top").alias("top"), *([F.concat("via", F.array("dst"), "_via").alias("via")] if self.via else [])]
        row = lambda part, dst, rest: F.struct(part.alias("part"), "src", dst.alias("dst"), *rest)
        beyond = row(F.when(F.col("src") == F.col("_to"), F.lit(LOOP)).otherwise(F.lit(LEFT)), F.col("_to"), joined)
        same = lambda part: row(part, F.col("dst"), plain)
        fates = F.when(F.col("fate").isNotNull(), F.array(same(F.col("fate")))).when(F.col("_to").isNotNull(), F.array(same(F.lit(INTO)), beyond)).otherwise(F.array(same(F.lit(LEFT))))
        return least(met.select(F.explode(fates).alias("x")).select("x.*"), "part", "src", "dst", "top", via=self.via)

    def local(self, work: Callable[[Block], Iterator[tuple]], schema: str, kinds: list[pa.DataType], names: list[str]) -> DataFrame:
        """What ``work`` tells of the links left, in one task; there are at most ``block_links`` of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            links = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))]
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

            for row in work(Block(links)):
                rows.append(row)
                if len(rows) == 10_000:
                    yield flush()
                    rows.clear()
            if rows:
                yield flush()

        return self.left().coalesce(1).mapInArrow(run, schema)

    def distances(self) -> DataFrame:
        """(node, root, depth[, path]): least number of links from every node to every root it reaches over one or
        more; with ``nodes_between`` the least nodes after it on a way of that length, the root last."""
        keep, via = ["node", "root", "depth", *(["path"] if self.via else [])], "path" if self.via else None
        none = [F.array().cast("array<int>").alias("path")] if self.via else []
        tops = self.first.where("top").select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *none)
        paths = [stage_path(tops)]
        if self.in_block:
            typed = [pa.int32()] * 3 + ([pa.list_(pa.int32())] if self.via else [])
            schema = "node int, root int, depth int" + (", path array<int>" if self.via else "")
            between = bool(self.via)
            paths.append(stage_path(self.local(lambda block: block.distances(between), schema, typed, keep)))
        else:
            paths.append(stage_path(relax(self.left(), tops, self.via)))
        spark = tops.sparkSession
        read = lambda: spark.read.schema(tops.schema).parquet(*paths)
        more = [F.concat("via", F.array("dst"), "path").alias("path")] if self.via else []
        step = lambda links, known: links.join(known.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "root", (F.col("w") + F.col("depth")).alias("depth"), *more)
        for at in reversed(range(len(self.rounds))):
            spliced = step(self.part(at, SPLICED), read())
            raked = least(step(self.part(at, RAKED), read().unionByName(spliced)), "node", "root", via=via, cost="depth")
            paths.append(stage_path(spliced.unionByName(raked)))
        return read().where("depth > 0")

    def cyclic(self) -> DataFrame:
        """(node): nodes that reach themselves over one or more links."""
        loops = stage_table(reduce(DataFrame.unionByName, (r.where(F.col("part") == LOOP).select(F.col("src").alias("node")) for r in [self.first, *self.rounds])).distinct())
        if self.in_block:
            label = self.local(lambda block: block.cycles(), "node int, label int", [pa.int32()] * 2, ["node", "label"])
        else:
            label = strong_components(self.left())
        label = stage_table(label)
        if self.rounds and not (loops.isEmpty() and label.isEmpty()):
            for at in reversed(range(len(self.rounds))):
                # a spliced node lies on a cycle if a node that linked to it is in one component with its target
                through = self.part(at, INTO).select(F.col("src").alias("into"), F.col("dst").alias("node")).join(self.part(at, SPLICED).select(F.col("src").alias("node"), F.col("dst").alias("to")), "node")
                named = through.join(label.select(F.col("node").alias("into"), F.col("label").alias("a")), "into", "left").join(label.select(F.col("node").alias("to"), F.col("label").alias("b")), "to", "left")
                inside = named.where("into = to or a = b").groupBy("node").agg(F.min(F.coalesce("b", "to")).alias("label"), F.min("to").alias("to"))
                whole = inside.select(F.explode(F.array("node", "to")).alias("node"), "label")
                label = stage_table(label.unionByName(whole).groupBy("node").agg(F.min("label").alias("label")))
        return label.select("node").unionByName(loops).distinct()

    def pairs(self) -> DataFrame:
        """(low, top, depth): every node with every node it reaches over one or more links, and the least number of them."""
        spark = self.first.sparkSession
        if self.in_block:
            start = self.local(lambda block: block.pairs(), "low int, top int, depth int", [pa.int32()] * 3, ["low", "top", "depth"])
        else:
            start = closure(self.left())
        paths = [stage_path(start)]
        read = lambda: spark.read.schema("low int, top int, depth int").parquet(*paths)
        for at in reversed(range(len(self.rounds))):
            up = upwards(self.part(at, SPLICED), read())
            into = self.part(at, INTO)
            below = into.join(read().unionByName(up).select("low", F.col("top").alias("src"), "depth"), "src").select("low", F.col("dst").alias("top"), (F.col("depth") + F.col("w")).alias("depth"))
            down = least(below.unionByName(into.select(F.col("src").alias("low"), F.col("dst").alias("top"), F.col("w").alias("depth"))), "low", "top", cost="depth")
            paths.append(stage_path(up.unionByName(down)))
            paths.append(stage_path(upwards(self.part(at, RAKED), read())))
        # a cycle that came down to a link from a node to itself
        loops = reduce(DataFrame.unionByName, (r.where(F.col("part") == LOOP).select(F.col("src").alias("low"), F.col("dst").alias("top"), F.col("w").alias("depth")) for r in [self.first, *self.rounds]))
        return read().where("low != top").unionByName(least(read().where("low = top").unionByName(loops), "low", "top", cost="depth"))


def upwards(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(low, top, depth) of the sources of links whose targets' pairs are known."""
    direct = links.select(F.col("src").alias("low"), F.col("dst").alias("top"), F.col("w").alias("depth"))
    further = links.join(pairs.select(F.col("low").alias("dst"), F.col("top").alias("_top"), "depth"), "dst").select(F.col("src").alias("low"), F.col("_top").alias("top"), (F.col("w") + F.col("depth")).alias("depth"))
    return least(direct.unionByName(further), "low", "top", cost="depth")


def relax(core: DataFrame, known: DataFrame, via: str | None = None) -> DataFrame:
    """(node, root, depth[, path]) of a distributed core's nodes: rounds of relaxation over those that changed."""
    path, more = ("path", [F.concat("via", F.array("dst"), "path").alias("path")]) if via else (None, [])
    value = F.struct("depth", *(["path"] if via else []))
    best, front = None, known
    while True:
        reached = core.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "root", (F.col("w") + F.col("depth")).alias("depth"), *more)
        new = least(reached, "node", "root", via=path, cost="depth")
        if best is not None:
            new = new.join(best.select("node", "root", value.alias("_old")), ["node", "root"], "left").where(F.col("_old").isNull() | (value < F.col("_old"))).drop("_old")
        new = stage_table(new)
        if new.isEmpty():
            return new if best is None else best
        best = new if best is None else stage_table(least(best.unionByName(new), "node", "root", via=path, cost="depth"))
        front = new


def closure(core: DataFrame) -> DataFrame:
    """(low, top, depth) of a distributed core, by doubling: its nodes reach one another, so it has that many rows."""
    known = stage_table(core.select(F.col("src").alias("low"), F.col("dst").alias("top"), F.col("w").alias("depth")))
    while True:
        longer = known.select("low", F.col("top").alias("mid"), "depth").join(known.select(F.col("low").alias("mid"), "top", F.col("depth").alias("more")), "mid").select("low", "top", (F.col("depth") + F.col("more")).alias("depth"))
        new = stage_table(least(known.unionByName(longer), "low", "top", cost="depth"))
        if new.join(known, ["low", "top", "depth"], "left_anti").isEmpty():
            return new
        known = new


def trim(edges: DataFrame) -> DataFrame:
    """Drop, again and again, nodes that lack links on either side: what is left lies on cycles or between them."""
    edges = stage_table(edges)
    left = edges.count()
    while left:
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = stage_table(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the least label that leads to each node along (src, dst)."""
    label = stage_table(start)
    while True:
        passed = edges.join(label.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        new = stage_table(label.unionByName(passed).groupBy("node").agg(F.min("label").alias("label")))
        if new.join(label, ["node", "label"], "left_anti").isEmpty():
            return new
        label = new


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes in strongly connected components of two or more nodes, by colouring.

    Each round colours nodes with the least node that reaches them; the nodes of a colour that reach back to its
    namesake are one component and leave.
    """
    done = None
    rest = trim(edges.select("src", "dst"))
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct()
        colour = spread(nodes.select("node", F.col("node").alias("label")), rest)
        both = rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        same = stage_table(both.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = spread(colour.where("node = label"), same)
        done = found if done is None else stage_table(done.unionByName(found))
        gone = found.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = trim(rest)
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    # a colour's namesake alone is no cycle
    return done.join(done.groupBy("label").count().where("count > 1").select("label"), "label", "left_semi").select("node", "label")


def roots_and_depths(current: DataFrame, key: str = "rfc_number", block_links: int = BLOCK_LINKS) -> DataFrame:
    """(key, root_number, depth), and (key, -1, -1) for each node that reaches itself."""
    work = Contraction(links_of(current, key), block_links)
    reached = work.distances().select(F.col("node").alias(key), F.col("root").alias("root_number"), "depth")
    loops = work.cyclic().select(F.col("node").alias(key), F.lit(-1).alias("root_number"), F.lit(-1).alias("depth"))
    return reached.unionByName(loops)


def paths(current: DataFrame, key: str = "rfc_number", block_links: int = BLOCK_LINKS) -> DataFrame:
    """(key, root_number, depth, path): a shortest path to each root, of several the one over the least numbers."""
    known = Contraction(links_of(current, key), block_links, nodes_between=True).distances()
    return known.select(F.col("node").alias(key), F.col("root").alias("root_number"), "depth", F.concat(F.array("node"), "path").alias("path"))


def descendants(current: DataFrame, key: str = "rfc_number", block_links: int = BLOCK_LINKS) -> DataFrame:
    """(key, descendant, depth): every node that builds on ``key``, with the least number of links."""
    found = Contraction(links_of(current, key), block_links).pairs()
    return found.select(F.col("top").alias(key), F.col("low").alias("descendant"), "depth")
