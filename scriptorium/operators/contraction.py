"""Contraction of a bounded block of links in one task: raking and unary-chain compression, undone in reverse."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

Cost = tuple[int, tuple[int, ...]]


class Block:
    """Links (src, dst, w, top[, via]) contracted to the end; ``out`` and ``into`` hold the core that is left.

    A cost is the number of links and the nodes between. ``steps`` has (node, links out, links in) of each node
    removed, in order; a raked node has no links in, a spliced one a single link out.
    """

    def __init__(self, links: list[tuple]) -> None:
        self.out: dict[int, dict[int, Cost]] = defaultdict(dict)
        self.into: dict[int, set[int]] = defaultdict(set)
        self.tops = sorted({link[1] for link in links if link[3]})
        for src, dst, w, _, *via in links:
            self.out[src][dst] = (w, tuple(via[0]) if via else ())
            self.into[dst].add(src)
        self.steps: list[tuple[int, list[tuple[int, Cost]], list[tuple[int, Cost]]]] = []
        self.loops: dict[int, int] = {}
        self.contract()

    def is_unary(self, node: int) -> bool:
        return len(self.out.get(node, ())) == 1 and bool(self.into.get(node))

    def contract(self) -> None:
        waiting = sorted(self.out, key=lambda n: not self.into.get(n))
        followed: set[int] = set()
        while waiting:
            node = waiting.pop()
            links = self.out.get(node)
            if not links:
                continue
            if not self.into.get(node):
                self.steps.append((node, list(links.items()), []))
                for dst in links:
                    self.into[dst].discard(node)
                    waiting.append(dst)
                del self.out[node]
            elif len(links) == 1:
                ((dst, cost),) = links.items()
                if node not in followed and dst not in followed and self.is_unary(dst):
                    followed.add(node)  # the far end of a chain goes first, so a hub's links are moved once
                    waiting += [node, dst]
                    continue
                self.splice(node, dst, cost)
                waiting += [dst, *(src for src, _ in self.steps[-1][2])]

    def splice(self, node: int, dst: int, cost: Cost) -> None:
        before = [(src, self.out[src].pop(node)) for src in sorted(self.into.pop(node))]
        self.steps.append((node, [(dst, cost)], before))
        del self.out[node]
        self.into[dst].discard(node)
        for src, (w, via) in before:
            if src == dst:
                self.loops[src] = min(w + cost[0], self.loops.get(src, w + cost[0]))
                continue
            longer = (w + cost[0], (*via, node, *cost[1]))
            if dst not in self.out[src] or longer < self.out[src][dst]:
                self.out[src][dst] = longer
            self.into[dst].add(src)

    def from_target(self, target: int) -> dict[int, Cost]:
        """Least cost and path of every core node that reaches the target."""
        best: dict[int, Cost] = {}
        heap: list[tuple[int, tuple[int, ...], int]] = [(0, (), target)]
        begun = False
        while heap:
            depth, path, node = heappop(heap)
            if begun:
                if node in best:
                    continue
                best[node] = (depth, path)
            begun = True
            for src in self.into.get(node, ()):
                if src not in best:
                    w, via = self.out[src][node]
                    heappush(heap, (depth + w, (*via, node, *path), src))
        return best

    def distances(self, between: bool) -> Iterator[tuple]:
        """(node, root, depth[, path after the node])."""
        known: dict[int, dict[int, Cost]] = defaultdict(dict)
        for top in self.tops:
            for node, cost in self.from_target(top).items():
                known[node][top] = cost
            known[top] = {top: (0, ())}
        for node, links, _ in reversed(self.steps):
            mine = known[node]
            for dst, (w, via) in links:
                for root, (depth, path) in known.get(dst, {}).items():
                    cost = (w + depth, (*via, dst, *path) if between else ())
                    if root not in mine or cost < mine[root]:
                        mine[root] = cost
        for node, roots in known.items():
            for root, (depth, path) in roots.items():
                if depth:
                    yield (node, root, depth, list(path)) if between else (node, root, depth)

    def cycles(self) -> Iterator[tuple[int, int]]:
        """(node, label): nodes on cycles of two or more nodes; those of one strong component share a label."""
        label = self.components()
        for node, links, before in reversed(self.steps):
            if not before:
                continue
            dst = links[0][0]
            if any(src == dst or (src in label and label[src] == label.get(dst)) for src, _ in before):
                label.setdefault(dst, dst)
                label[node] = label[dst]
        yield from label.items()

    def components(self) -> dict[int, int]:
        """Strong components of two or more core nodes, by depth-first search with an explicit stack."""
        order: dict[int, int] = {}
        low: dict[int, int] = {}
        label: dict[int, int] = {}
        path: list[int] = []
        on_path: set[int] = set()
        for start in list(self.out):
            if start in order:
                continue
            order[start] = low[start] = len(order)
            path.append(start)
            on_path.add(start)
            work = [(start, iter(self.out[start]))]
            while work:
                node, ahead = work[-1]
                following = next(ahead, None)
                if following is not None:
                    if following not in order:
                        order[following] = low[following] = len(order)
                        path.append(following)
                        on_path.add(following)
                        work.append((following, iter(self.out.get(following, ()))))
                    elif following in on_path:
                        low[node] = min(low[node], order[following])
                    continue
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = [path.pop()]
                    while members[-1] != node:
                        members.append(path.pop())
                    on_path.difference_update(members)
                    if len(members) > 1:
                        label.update(dict.fromkeys(members, min(members)))
        return label

    def pairs(self) -> Iterator[tuple[int, int, int]]:
        """(low, top, depth): every node with every node it reaches."""
        above: dict[int, dict[int, int]] = defaultdict(dict)
        below: dict[int, dict[int, int]] = defaultdict(dict)

        def put(low: int, top: int, depth: int) -> None:
            if depth < above[low].get(top, depth + 1):
                above[low][top] = below[top][low] = depth

        for node, depth in self.loops.items():
            put(node, node, depth)
        for target in list(self.into):
            for node, (depth, _) in self.from_target(target).items():
                put(node, target, depth)
        for node, links, before in reversed(self.steps):
            for dst, (w, _) in links:
                put(node, dst, w)
                for top, depth in list(above[dst].items()):
                    put(node, top, w + depth)
            for src, (w, _) in before:
                put(src, node, w)
                for low, depth in list(below[src].items()):
                    put(low, node, w + depth)
        for low, tops in above.items():
            for top, depth in tops.items():
                yield low, top, depth
