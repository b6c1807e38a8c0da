"""Walks whose result depends on their order: plain Python over one component or one probe's surroundings at a time.

``per_component`` ships each connected part of the graph to one task; the walkers below see it as a LocalGraph. Where a part is too large for that and the
walk has a leash, ``per_start`` ships to each start only what lies within its leash.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.trails import oriented
from strandflow.lineage import near_components, written
from strandflow.operators.graph import AssemblyGraph
from strandflow.operators.streams import grouped_rows, in_groups  # noqa: F401
from strandflow.operators.traverse import min_distances


@dataclass
class LocalGraph:
    """Adjacency of signed nodes with lengths, coverages and the reads on each node."""

    k: int
    length: dict[int, int]
    coverage: dict[int, float]
    out: dict[int, list[int]]
    reads: dict[int, set[int]] = field(default_factory=dict)
    probes: dict[int, tuple[int, int]] = field(default_factory=dict)  # (signed node, offset) by probe
    gaps: dict[int, tuple[int, int]] = field(default_factory=dict)  # (start, stop) as signed nodes, by gap
    own: int | None = None  # the probe whose surroundings these are, where they are one's

    def asked(self) -> list[int]:
        """The probes to start from, in order."""
        return sorted(self.probes) if self.own is None else [self.own]

    @classmethod
    def of(cls, k: int, nodes, arcs, reads=()) -> LocalGraph:
        """nodes: (id, length, coverage); arcs: signed (src, dst); reads: (node, read)."""
        out = defaultdict(set)
        for a, b in arcs:
            out[a].add(b)
            out[-b].add(-a)
        on = defaultdict(set)
        for n, r in reads:
            on[n].add(r)
        rows = list(nodes)
        return cls(k, {n: le for n, le, _ in rows}, {n: c for n, _, c in rows}, {s: sorted(t, key=lambda x: (abs(x), -x)) for s, t in out.items()}, on)

    def after(self, node: int) -> list[int]:
        return self.out.get(node, [])

    def bp(self, path: list[int]) -> int:
        return sum(self.length[abs(n)] for n in path) + self.k - 1


def cycle_counts(path: list[int]) -> Counter:
    """How often each cycle is walked, occurrences that overlap counting once. A cycle is what lies between a node and its next return, named by
    its smallest rotation."""
    last: dict[int, int] = {}
    ends: dict[tuple, int] = {}
    counts: Counter = Counter()
    for j, n in enumerate(path):
        if n in last:
            cycle = path[last[n] : j]
            name = min(tuple(cycle[r:] + cycle[:r]) for r in range(len(cycle)))
            if last[n] >= ends.get(name, -1):
                counts[name] += 1
                ends[name] = j
        last[n] = j
    return counts


@dataclass
class PathSet:
    paths: list[list[int]]
    circular_paths_detected: bool = False
    max_path_limit_exceeded: bool = False
    explored: int = 0


def coherent(g: LocalGraph, path: list[int], recoherence: int | None, min_reads: int) -> bool:
    """Whether enough reads span the end of the path: every node of the last stretch of ``recoherence`` bases before the last node, and that."""
    if not recoherence or len(path) < 3:
        return True
    tail, size = [path[-1]], 0
    for n in reversed(path[:-1]):
        tail.append(n)
        size += g.length[abs(n)]
        if size >= recoherence:
            break
    spanning = set.intersection(*(g.reads.get(abs(n), set()) for n in tail))
    return len(spanning) >= min_reads


def _to_stop(g: LocalGraph, stop: int) -> dict[int, int]:
    """Least bases of nodes to leave before ``stop`` is entered."""
    back = defaultdict(list)
    for s, outs in g.out.items():
        for t in outs:
            back[t].append(s)
    best, queue = {stop: 0}, [(0, stop)]
    while queue:
        d, n = heapq.heappop(queue)
        if d > best[n]:
            continue
        for p in back[n]:
            e = d + g.length[abs(p)]
            if e < best.get(p, e + 1):
                best[p] = e
                heapq.heappush(queue, (e, p))
    return best


def paths_between(
    g: LocalGraph, start: int, stop: int, leash: int | None = None, max_cycles: int = 1, max_paths: int | None = 2196,
    max_explore_nodes: int | None = None, recoherence: int | None = None, min_reads: int = 1,
) -> PathSet:
    """All walks from start to stop that repeat no simple cycle more than ``max_cycles`` times, of at most ``leash`` bases before stop. Beyond a cap the
    set is empty. Only nodes from which stop is still within the leash are entered."""
    rest = _to_stop(g, stop)
    found, circular, explored = [], False, 0
    if start not in rest:
        return PathSet([])
    stack = [([start], 0)]
    while stack:
        path, used = stack.pop()
        if path[-1] == stop and len(path) > 1 or start == stop == path[-1] and len(path) == 1:
            found.append(path)
            if max_paths is not None and len(found) > max_paths:
                return PathSet([], circular, True, explored)
        explored += 1
        if max_explore_nodes is not None and explored > max_explore_nodes:
            return PathSet([], circular, True, explored)
        if path[-1] == stop and len(path) > 1:
            continue
        here = used + g.length[abs(path[-1])]
        for n in reversed(g.after(path[-1])):
            if n not in rest or leash is not None and here + rest[n] > leash:
                continue
            new = path + [n]
            if n in path:
                circular = True
                if max(cycle_counts(new).values()) > max_cycles:
                    continue
            if len(g.after(path[-1])) > 1 and not coherent(g, new, recoherence, min_reads):
                continue
            stack.append((new, here))
    return PathSet(found, circular, False, explored)


def walks(g: LocalGraph, start: int, leash: int | None = None, max_cycles: int = 1, max_paths: int | None = 2196) -> PathSet:
    """All walks from start, each until it ends, is longer than the leash or could only repeat a cycle more than ``max_cycles`` times. Beyond the cap the set is empty."""
    found, circular, explored, stack = [], False, 0, [[start]]
    while stack:
        path = stack.pop()
        explored += 1
        nexts = [] if leash is not None and g.bp(path) > leash else g.after(path[-1])
        circular |= any(n in path for n in nexts)
        nexts = [n for n in nexts if n not in path or max(cycle_counts([*path, n]).values()) <= max_cycles]
        if not nexts:
            found.append(path)
            if max_paths is not None and len(found) > max_paths:
                return PathSet([], circular, True, explored)
        stack += [[*path, n] for n in reversed(nexts)]
    return PathSet(found, circular, False, explored)


def wander(g: LocalGraph, probes: list[int], leash: int, recoherence: int | None = None, min_reads: int = 1, only: list[int] | None = None) -> dict[tuple[int, int], int]:
    """{(i, j): distance} for i <= j (and i in ``only``): the least bases entered from probe i's node until probe j's is entered from the other side. Read support is
    asked for at forks only; states are the tails it depends on."""
    goals = defaultdict(list)
    for j, p in enumerate(probes):
        goals[-p].append(j)
    out: dict[tuple[int, int], int] = {}

    def tail(path):
        size, at = 0, len(path) - 1
        while at > 0 and recoherence and size < recoherence:
            at -= 1
            size += g.length[abs(path[at])]
        return tuple(path[at:])

    for i, start in enumerate(probes):
        if only is not None and i not in only:
            continue
        queue, done = [(0, (start,), False)], set()
        while queue:
            dist, path, entered = heapq.heappop(queue)
            if path in done:
                continue
            if entered:  # the start isn't done as it is left: a way may come back to it, where another probe faces it
                done.add(path)
                for j in goals.get(path[-1], ()):
                    if j >= i:
                        out[i, j] = min(dist, out.get((i, j), dist))
            nexts = g.after(path[-1])
            for n in nexts:
                d = dist + g.length[abs(n)]
                if d > leash:
                    continue
                whole = [*path, n]
                if len(nexts) > 1 and not coherent(g, whole, recoherence, min_reads):
                    continue
                heapq.heappush(queue, (d, tail(whole), True))
    return out


def tip_distance(g: LocalGraph, node: int, limit: int) -> int:
    """Most bases of a walk from ``node``, as soon as it is over ``limit``: a node is left again only after a longer way to it, and a cycle is no tip."""
    best, stack, far = {}, [(node, g.length[abs(node)])], 0
    while stack:
        n, used = stack.pop()
        far = max(far, used)
        if far > limit:
            break
        for m in g.after(n):
            d = used + g.length[abs(m)]
            if d > best.get(m, -1):
                best[m] = d
                stack.append((m, d))
    return far


@dataclass(frozen=True)
class AssembleOptions:
    max_tip_length: int = 200
    recoherence: int | None = None
    min_reads: int = 2
    max_coverage_at_fork: float | None = None
    leash: int | None = None
    min_contig_size: int = 500
    min_start_coverage: float = 0.0
    min_start_length: int = 0
    max_bubble_length: int = 500
    bubble_node_limit: int | None = 20
    bubble_fork_limit: int | None = 20
    max_cycles: int = 1


def without_tips(g: LocalGraph, nexts: list[int], limit: int) -> list[int]:
    """Branches that aren't short tips; where all are, the longest (ties: the lower id)."""
    far = {n: tip_distance(g, n, limit) for n in nexts}
    kept = [n for n in nexts if far[n] > limit]
    return kept or sorted(nexts, key=lambda n: (-far[n], abs(n)))[:1]


def assemble_from(g: LocalGraph, path: list[int], opts: AssembleOptions = AssembleOptions()) -> list[int]:
    """The path walked on until it ends, forks for good, is longer than the leash or comes back to a node (which is included)."""
    path = list(path)
    seen = set(path)
    while True:
        if opts.leash is not None and g.bp(path) > opts.leash:
            return path
        nexts = g.after(path[-1])
        if len(nexts) > 1:
            nexts = without_tips(g, nexts, opts.max_tip_length)
        if len(nexts) > 1 and opts.recoherence:
            nexts = [n for n in nexts if coherent(g, [*path, n], opts.recoherence, opts.min_reads)]
        if len(nexts) > 1 and opts.max_coverage_at_fork is not None:
            nexts = [n for n in nexts if g.coverage[abs(n)] <= opts.max_coverage_at_fork]
        if len(nexts) != 1:
            return path
        path.append(nexts[0])
        if nexts[0] in seen:
            return path
        seen.add(nexts[0])


def _unseen(path: list[int], seen: set[int]) -> list[int]:
    while path and abs(path[-1]) in seen:
        path = path[:-1]
    return path


def assemble_all(g: LocalGraph, opts: AssembleOptions = AssembleOptions()) -> Iterator[list[int]]:
    """Contigs in order of their start nodes; each node starts or ends one contig at most."""
    seen: set[int] = set()
    for start in sorted(g.length):
        if start in seen or g.coverage[start] < opts.min_start_coverage or g.length[start] < opts.min_start_length:
            continue
        back = assemble_from(g, [-start], opts)
        if len(set(map(abs, back))) < len(back):
            back = back[:-1]
        back = _unseen(back, seen) or [-start]
        path = [-n for n in reversed(back)]
        while len(path) > 1 and g.bp(path[:1]) <= opts.max_tip_length and len(g.after(-path[1])) > 1:
            path = path[1:]
        path = assemble_from(g, path, opts)
        kept = _unseen(path, seen)
        seen.update(map(abs, path))
        if kept and g.bp(kept) >= opts.min_contig_size:
            yield kept


class Bubble:
    """All walks from ``fork`` to the node ``close`` where they meet again, neither included: ``before`` has the steps, backwards; None stands for the fork."""

    def __init__(self, fork: int, close: int, before: dict[int, list[int | None]], order: Callable[[int], tuple], max_cycles: int = 1, turned: bool = False):
        self.fork, self.close, self.before, self.order, self.max_cycles, self.turned = fork, close, before, order, max_cycles, turned

    def paths(self) -> Iterator[list[int]]:
        """Each path, found backwards from the end, best covered nodes first; with the fork before it no cycle is walked more than ``max_cycles`` times."""
        stack = [[self.close]]
        within = lambda p: max(cycle_counts(p).values(), default=0) <= self.max_cycles
        while stack:
            p = stack.pop()
            for n in sorted(self.before[p[0]], key=lambda n: (n is not None, self.order(n) if n is not None else ())):
                if n is not None and (n not in p or within([n, *p])):
                    stack.append([n, *p])
                elif n is None and within([self.fork, *p]):
                    stack.append([None, *p])
            while stack and stack[-1][0] is None:
                found = stack.pop()[1:-1]
                yield [-n for n in reversed(found)] if self.turned else found

    def steps(self) -> list[tuple[int, int]]:
        """The arcs of all paths, from the fork to the end: they say what the paths are, however many these are."""
        found = [(self.fork if p is None else p, n) for n, ps in self.before.items() for p in ps]
        return sorted({(-b, -a) for a, b in found} if self.turned else set(found))

    def reference(self) -> list[int]:
        return next(self.paths())

    def nodes(self) -> set[int]:
        """What lies on any walk from the fork to the end."""
        found, stack = set(), [self.close]
        while stack:
            for n in self.before[stack.pop()]:
                if n is not None and n not in found:
                    found.add(n)
                    stack.append(n)
        return {-n for n in found} if self.turned else found

    def reverse(self) -> Bubble:
        return Bubble(self.fork, self.close, self.before, self.order, self.max_cycles, not self.turned)

    def coverage(self, g: LocalGraph) -> float:
        ids = {abs(n) for n in self.nodes()}
        size = sum(g.length[n] for n in ids)
        return sum(g.coverage[n] * g.length[n] for n in ids) / size if size else 0.0


@dataclass
class MetaPath:
    """Nodes and bubbles in turn; a bubble's ends are the nodes beside it."""

    parts: list
    fate: str | None = None

    def reference(self) -> list[int]:
        return [n for p in self.parts for n in (p.reference() if isinstance(p, Bubble) else [p])]

    def nodes(self) -> set[int]:
        return {n for p in self.parts for n in (p.nodes() if isinstance(p, Bubble) else [p])}

    def bp(self, g: LocalGraph) -> int:
        return g.bp(self.reference())

    def coverage(self, g: LocalGraph) -> float:
        path = self.reference()
        return sum(g.coverage[abs(n)] * g.length[abs(n)] for n in path) / sum(g.length[abs(n)] for n in path)

    def reverse(self) -> MetaPath:
        return MetaPath([p.reverse() if isinstance(p, Bubble) else -p for p in reversed(self.parts)], self.fate)

    def without_seen_end(self, seen: set[int]) -> MetaPath:
        """Without the last parts as long as those hold a node (id) seen before."""
        parts = list(self.parts)
        while parts and any(abs(n) in seen for n in (parts[-1].nodes() if isinstance(parts[-1], Bubble) else [parts[-1]])):
            parts.pop()
        if parts and isinstance(parts[-1], Bubble):  # a bubble doesn't stand without its end
            parts.pop()
        return MetaPath(parts, self.fate)

    def shorthand(self) -> str:
        """Nodes in turn, and bubbles with each of their paths, which may be very many: '1s,{2s|3s},4s'."""
        return ",".join("{" + "|".join(map(_trail, p.paths())) + "}" if isinstance(p, Bubble) else _trail([p]) for p in self.parts)

    def by_steps(self) -> str:
        """Nodes in turn, and bubbles by their steps: '1s,{1s>2s|1s>3s|2s>4s|3s>4s},4s'."""
        return ",".join("{" + "|".join(f"{_trail([a])}>{_trail([b])}" for a, b in p.steps()) + "}" if isinstance(p, Bubble) else _trail([p]) for p in self.parts)

    def nested(self, g: LocalGraph) -> list[dict]:
        """The parts with their coverages: regular nodes, and bubbles with their steps and nodes."""
        node = lambda n: {"node": _trail([n]), "coverage": g.coverage[abs(n)]}
        return [
            {"type": "bubble", "steps": [[_trail([a]), _trail([b])] for a, b in p.steps()], "nodes": [node(n) for n in sorted(p.nodes())]} if isinstance(p, Bubble) else {"type": "regular", **node(p)}
            for p in self.parts
        ]


def _trail(path: list[int]) -> str:
    return ",".join(f"{abs(n)}{'s' if n > 0 else 'e'}" for n in path)


def _reached(after: dict[int, list[int]], starts: list[int], gone: int | None = None) -> set[int]:
    """What walks from ``starts`` that avoid ``gone`` come to, the starts included."""
    stack = [n for n in starts if n != gone]
    seen = set(stack)
    while stack:
        new = [m for m in after.get(stack.pop(), ()) if m != gone and m not in seen]
        seen.update(new)
        stack += new
    return seen


def find_bubble(g: LocalGraph, root: int, opts: AssembleOptions, nexts: list[int] | None = None) -> tuple[Bubble | None, int | None, str | None]:
    """(bubble, the node where it closes, fate). Nodes are entered nearest first, short tips left aside. The bubble closes at a node that every way to
    what is still to be entered goes through; a node to which a further way is found is asked again, unless that way came round from it. Longer
    tips are dropped, but for the only one where nothing else is left; a node from which all ways only come round closes nothing."""
    nexts = without_tips(g, g.after(root), opts.max_tip_length) if nexts is None else nexts
    dist, after = {n: 0 for n in nexts}, {}
    before: dict[int, list] = {n: [None] for n in nexts}
    queue, waiting, ends, forks = [(0, i, n) for i, n in enumerate(nexts)], set(nexts), [], 0

    def closed(n):
        inner = _reached(after, nexts, n)
        kept = {m: [p for p in ps if p is None or p in inner] for m, ps in before.items() if m in inner or m == n}
        return Bubble(root, n, kept, lambda x: (g.coverage[abs(x)], -abs(x)), opts.max_cycles), n, None

    while queue:
        _, _, n = heapq.heappop(queue)
        waiting.discard(n)
        if dist[n] > opts.max_bubble_length:
            return None, None, "diverges"
        ahead = g.after(n)
        beyond = _reached(after, ahead)
        only_round = bool(ahead) and beyond - {n} <= after.keys() and not beyond & waiting
        if not only_round and not _reached(after, nexts, n) & waiting:
            return closed(n)
        if n in after:
            continue  # asked again, and not the end
        if len(ahead) > 1:
            ahead = without_tips(g, ahead, opts.max_tip_length)
        forks += len(ahead) > 1
        if not ahead:
            ends.append(n)
        for m in ahead:
            before.setdefault(m, []).append(n)
            dist[m] = min(dist.get(m, dist[n] + g.length[abs(n)]), dist[n] + g.length[abs(n)])
            if m not in waiting and n not in _reached(after, [m]):
                heapq.heappush(queue, (dist[m], len(dist) + len(after), m))
                waiting.add(m)
        after[n] = ahead
        if opts.bubble_fork_limit is not None and forks > opts.bubble_fork_limit or opts.bubble_node_limit is not None and len(dist) > opts.bubble_node_limit:
            return None, None, "too many nodes in bubble"
    return closed(ends[0]) if len(ends) == 1 else (None, None, "dead end")


def assemble_bubbly(g: LocalGraph, path: list, opts: AssembleOptions = AssembleOptions()) -> MetaPath:
    """The path (nodes and bubbles) walked on through bubbles that close again; the fate tells how it ended."""
    parts, seen, at = list(path), MetaPath(list(path)).nodes(), path[-1]
    while True:
        nexts = g.after(at)
        if len(nexts) > 1:
            nexts = without_tips(g, nexts, opts.max_tip_length)
        if not nexts:
            return MetaPath(parts, "dead end")
        if all(n in seen for n in nexts):
            return MetaPath(parts, "circuit")
        if len(nexts) > 1:
            bubble, close, fate = find_bubble(g, at, opts, nexts)
            if bubble is None:
                return MetaPath(parts, fate)
            if close in seen:  # it leads round to what was passed
                return MetaPath(parts, "circuit")
            parts.append(bubble)
            seen |= bubble.nodes()
            nexts = [close]
        at = nexts[0]
        seen.add(at)
        parts.append(at)


def assemble_all_bubbly(g: LocalGraph, opts: AssembleOptions = AssembleOptions()) -> Iterator[MetaPath]:
    """Contigs through bubbles in order of their start nodes; each node starts or ends one contig at most."""
    seen: set[int] = set()
    for start in sorted(g.length):
        if start in seen or g.coverage[start] < opts.min_start_coverage or g.length[start] < opts.min_start_length:
            continue
        back = assemble_bubbly(g, [-start], opts)
        far = back.without_seen_end(seen).parts if back.fate != "circuit" else []
        found = assemble_bubbly(g, [-far[-1] if far else start], opts)
        kept = found.without_seen_end(seen)
        seen.update(abs(n) for n in found.nodes())
        if kept.parts and kept.bp(g) >= opts.min_contig_size:
            yield kept


def fluff(g: LocalGraph, probes: list[int], leash: int) -> list[Iterator[tuple[list[int], str]]]:
    """For each probe all acyclic paths with their fates: at another probe's node ('terminal'), at an end ('dead_end'), past the leash
    ('beyond_leash'; lengths include k - 1). Paths come as they are found, however many there are."""
    ends = {abs(p) for p in probes}

    def beyond(start: int) -> Iterator[tuple[list[int], str]]:
        stack = [([start], g.bp([start]))]
        while stack:
            p, bp = stack.pop()
            if len(p) > 1 and abs(p[-1]) in ends:
                yield p, "terminal"
                continue
            if bp >= leash:
                yield p, "beyond_leash"
                continue
            nexts = [n for n in g.after(p[-1]) if n not in p]
            if not nexts:
                yield p, "dead_end"
            stack += [(p + [n], bp + g.length[abs(n)]) for n in reversed(nexts)]

    return [beyond(p) for p in probes]


def depth_first(g: LocalGraph, start: int, visit: Callable[[list[int]], bool]) -> None:
    """Calls ``visit`` with the trail to each newly found oriented node, lower ids first; a false answer prunes."""
    seen, stack = set(), [[start]]
    while stack:
        trail = stack.pop()
        if trail[-1] in seen:
            continue
        seen.add(trail[-1])
        if visit(trail):
            stack += [trail + [n] for n in reversed(g.after(trail[-1])) if n not in seen]


def _local_rows(names: str, nodes: DataFrame, edges: DataFrame, reads: DataFrame | None, probes: DataFrame | None, gaps: DataFrame | None) -> DataFrame:
    """One table (group, kind, a, b, c) of what each group's LocalGraph holds, from tables that have the group's column ``names``."""
    none = F.lit(None).cast("double")
    row = lambda df, kind, a, b, c=none: df.select(F.col(names).cast("long").alias("group"), F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("double").alias("c"))
    col = F.col
    rows = row(nodes, 0, col("node_id"), col("length"), col("cov_sum") / col("length")).unionByName(row(edges, 1, col("src"), col("dst")))
    if reads is not None:
        rows = rows.unionByName(row(reads, 2, col("node_id"), col("read_id")))
    if probes is not None:
        rows = rows.unionByName(row(probes, 3, col("probe_idx"), col("node"), col("offset")))
    if gaps is not None:
        rows = rows.unionByName(row(gaps, 4, col("gap_id"), col("start"), col("stop")))
    return rows


def _walked(rows: DataFrame, k: int, walk: Callable[[LocalGraph], Iterable[tuple]], schema: str, by_start: bool) -> DataFrame:
    def found(key: int, some: list[tuple]) -> Iterable[tuple]:
        part = [[], [], [], [], []]  # nodes, arcs, reads, probes, gaps
        for kind, a, b, c in some:
            part[kind].append((a, b) if kind in (1, 2) else (a, b, c))
        g = LocalGraph.of(k, part[0], part[1], part[2])
        g.probes, g.gaps = ({a: (b, int(c)) for a, b, c in part[kind]} for kind in (3, 4))
        g.own = key if by_start else None
        return walk(g)

    return in_groups(rows, found, schema)


def node_parts(graph: AssemblyGraph) -> DataFrame:
    """(node_id, length, cov_sum, component): nodes with the connected part they are on, named by its smallest node."""
    comps = near_components(graph.arcs, "begin_id", "end_id", "walk")
    named = graph.nodes.select("node_id", "length", "cov_sum").join(comps.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    return written(named, "walk-parts")


def per_component(
    graph: AssemblyGraph, walk: Callable[[LocalGraph], Iterable[tuple]], schema: str, probes: DataFrame | None = None, gaps: DataFrame | None = None,
    leash: int | None = None, largest: int = 100_000,
) -> DataFrame:
    """The rows of ``walk`` over each connected part of the graph, one task's work each; results are united. Probes (probe_idx, node, offset) and gaps (gap_id, start,
    stop) travel with the part that holds their (first) node. Where a part has more than ``largest`` nodes and the walk goes no further than ``leash`` from a probe
    or a gap's start, each is walked over its own surroundings instead."""
    named = node_parts(graph)
    if leash is not None and named.groupBy("component").count().where(F.col("count") > largest).limit(1).count():
        return per_start(graph, walk, schema, leash, probes, gaps)
    by_node = named.select(F.col("node_id").alias("_id"), "component")
    of = lambda df, node: None if df is None else df.join(by_node, F.abs(node) == F.col("_id"))
    # a LocalGraph adds the twins of its arcs
    arcs = graph.arcs.select(oriented(F.col("begin_id"), F.col("begin_fwd")).alias("src"), oriented(F.col("end_id"), F.col("end_fwd")).alias("dst"))
    return _walked(_local_rows("component", named, of(arcs, "src"), of(graph.noded_reads, "node_id"), of(probes, "node"), of(gaps, "start")), graph.k, walk, schema, False)


def per_start(graph: AssemblyGraph, walk: Callable[[LocalGraph], Iterable[tuple]], schema: str, leash: int, probes: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """``walk`` over the surroundings of each probe or gap: all that is within the leash ahead of its node, and the probes there."""
    edges = written(graph.edges(), "start-edges")
    own = gaps.select(F.col("gap_id").alias("source"), "start") if gaps is not None else probes.select(F.col("probe_idx").alias("source"), F.col("node").alias("start"))
    near = written(min_distances(edges, graph.nodes, own, leash).select(F.col("source").alias("around"), F.col("node").alias("_at")), "start-near")
    ids = near.select("around", F.abs("_at").alias("_id")).distinct()
    inner = near.join(edges, F.col("_at") == F.col("src")).select("around", "src", "dst").join(near.withColumnRenamed("_at", "dst"), ["around", "dst"], "left_semi")
    of = lambda df, node: None if df is None else df.join(ids, F.abs(node) == F.col("_id"))
    there = None if gaps is None else gaps.withColumn("around", F.col("gap_id"))
    return _walked(_local_rows("around", of(graph.nodes, "node_id"), inner, of(graph.noded_reads, "node_id"), of(probes, "node"), there), graph.k, walk, schema, True)


def assembled(graph: AssemblyGraph, opts: AssembleOptions = AssembleOptions(), bubbly: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """(path, fate, shorthand, nested, coverage): contigs of the whole graph, or those walked from ``starts`` (start_id, node) alone; with ``bubbly`` through bubbles,
    of which ``path`` takes the best covered way and ``nested``, a JSON text, has the steps."""

    alone = starts is not None

    def walk(g: LocalGraph) -> Iterator[tuple]:
        trails = [[node] for _, (node, _) in sorted(g.probes.items())]
        if bubbly:
            found = [assemble_bubbly(g, t, opts) for t in trails] if alone else assemble_all_bubbly(g, opts)
        else:
            found = (MetaPath(p, "end") for p in ([assemble_from(g, t, opts) for t in trails] if alone else assemble_all(g, opts)))
        return ((m.reference(), m.fate, m.by_steps(), json.dumps(m.nested(g)), m.coverage(g)) for m in found)

    probes = None if starts is None else starts.select(F.col("start_id").alias("probe_idx"), "node", F.lit(0).alias("offset"))
    return per_component(graph, walk, "path array<int>, fate string, shorthand string, nested string, coverage double", probes=probes)
