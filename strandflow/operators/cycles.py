"""Cycles of a directed graph in rounds of joins: strongly connected parts, loops cut open, levels and path counts over what is left.

Unforked stretches are ranked as lists first and stand as one node each, so rounds follow the forks on a way and not its nodes. Cycles are cut where they come back to: of
each strongly connected part the node that walks from the starts come to first (ties: the smaller) is the head of a loop, and the steps that lead back to it are cut; what
is left of the part may hold inner loops, with heads of their own. Where a loop is entered at one node alone these steps are the back edges of any depth-first
search, whatever its order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.lineage import bounded, forget, measured, written
from strandflow.operators.streams import in_groups, in_parts
from strandflow.ranking import list_ranks

_UNFINISHED = "the traversal isn't finished after so many rounds"


def _empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def spread(steps: DataFrame, values: DataFrame, tag: str, rounds: int = 10_000) -> DataFrame:
    """(node, value): the smallest value that comes to each node along steps (src, dst, and w where each adds its own to the value); values (node, value)."""
    more = (lambda v: F.col(v) + F.col("w")) if "w" in steps.columns else F.col
    kind = values.schema["value"].dataType
    cur = written(values.groupBy("node").agg(F.min("value").alias("value")).withColumn("moved", F.lit(True)), tag)
    for _ in range(rounds):
        once = cur.where("moved").join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), more("value").cast(kind).alias("_v"))
        twice = once.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), more("_v").cast(kind).alias("_v"))  # two steps a round
        told = once.unionByName(twice).select("node", F.col("_v").alias("value"), F.lit(None).cast(kind).alias("was"))
        both = cur.select("node", "value", F.col("value").alias("was")).unionByName(told).groupBy("node").agg(F.min("value").alias("value"), F.min("was").alias("was"))
        new = both.select("node", "value", (F.col("was").isNull() | (F.col("value") < F.col("was"))).alias("moved"))
        old = cur
        cur, seen = measured(new, tag, moved=F.count_if("moved"))
        forget(old)
        if not seen["moved"]:
            return cur.select("node", "value")
    raise RuntimeError(_UNFINISHED)


def strongly_connected(edges: DataFrame, tag: str = "scc", rounds: int = 10_000) -> DataFrame:
    """(node, part): nodes that lie on a cycle of two nodes or more, named by a node of their part. Each round colours every node with the smallest that reaches it; what reaches
    a colour's own node within the colour is that node's part."""
    left, seen = measured(edges.select("src", "dst").where("src != dst").distinct(), f"{tag}-edges", n=F.count(F.lit(1)))
    found = []
    for _ in range(rounds):
        n = None
        while n != (n := seen["n"]) and n:  # what nothing leads to, or leads to nothing, is on no cycle
            old = ends = left
            for _ in range(2):
                before, ends = ends, ends.join(ends.select(F.col("dst").alias("src")), "src", "left_semi")
                ends = ends.join(before.select(F.col("src").alias("dst")), "dst", "left_semi")
            left, seen = measured(ends.select("src", "dst"), f"{tag}-edges", n=F.count(F.lit(1)))
            forget(old)
        if not n:
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = written(spread(left, nodes.select("node", F.col("node").alias("value")), f"{tag}-colours"), f"{tag}-coloured")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("value").alias(f"_{end}"))
        same = written(left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("c")), f"{tag}-same")
        roots = colour.where("node = value").select("node", F.lit(0).alias("value"))
        part = written(spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, f"{tag}-back").select("node").join(colour, "node"), f"{tag}-parts")
        found.append(part)
        gone = part.select("node")
        rest = same.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        old = left
        left, seen = measured(rest.select("src", "dst"), f"{tag}-edges", n=F.count(F.lit(1)))
        forget(old, same, colour)
    else:
        raise RuntimeError(_UNFINISHED)
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0)
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    several = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return rows.join(several, "value", "left_semi").select("node", F.col("value").alias("part"))


def _cut(steps: DataFrame, depths: DataFrame, rounds: int = 1_000) -> DataFrame:
    """(src, dst): the steps to cut so that no cycle is left."""
    loops = steps.where("src = dst").select("src", "dst")
    cut, left = [written(loops, "cut-loops")], steps.where("src != dst").select("src", "dst")
    for _ in range(rounds):
        parts, seen = measured(strongly_connected(left), "cut-parts", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        heads = parts.join(depths, "node").groupBy("part").agg(F.min(F.struct("value", "node"))["node"].alias("head"))
        of = lambda end: parts.select(F.col("node").alias(end), F.col("part").alias(f"_{end}"))
        inner = left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").join(heads, F.col("_src") == F.col("part"))
        inner = written(inner.select("src", "dst", (F.col("dst") == F.col("head")).alias("back")), "cut-inner")
        cut.append(inner.where("back").select("src", "dst"))
        left = inner.where("not back").select("src", "dst")
    else:
        raise RuntimeError(_UNFINISHED)
    out = cut[0]
    for some in cut[1:]:
        out = out.unionByName(some)
    return out


def _components(on: dict) -> Iterator[list]:
    """The strongly connected parts of two nodes or more of steps node: [node] (Tarjan's way, without recursion)."""
    index, low, held, stack = {}, {}, set(), []
    for root in on:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        calls = [(root, iter(on[root]))]
        while calls:
            n, ways = calls[-1]
            for m in ways:
                if m not in index:
                    index[m] = low[m] = len(index)
                    stack.append(m)
                    held.add(m)
                    calls.append((m, iter(on.get(m, ()))))
                    break
                if m in held:
                    low[n] = min(low[n], index[m])
            else:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[n])
                if low[n] == index[n]:
                    part = []
                    while not part or part[-1] != n:
                        part.append(stack.pop())
                        held.discard(part[-1])
                    if len(part) > 1:
                        yield part


@dataclass
class SmallLevels:
    """The levels of a part that fits a task, with nodes instead of lists: ``kept`` (node: its ways on) and ``cut`` steps of what ``starts`` come to."""

    starts: set
    kept: dict = field(default_factory=dict)
    cut: list = field(default_factory=list)

    @classmethod
    def of(cls, edges: Iterable[tuple], starts: set) -> SmallLevels:
        on = defaultdict(set)
        for a, b in edges:
            on[a].add(b)
        depth, front = dict.fromkeys(starts, 0), list(starts)
        for n in front:
            for m in on.get(n, ()):
                if m not in depth:
                    depth[m] = depth[n] + 1
                    front.append(m)
        cut = {(n, n) for n in depth if n in on.get(n, ())}
        todo = [{n: [m for m in on.get(n, ()) if m != n] for n in depth}]
        while todo:
            left = todo.pop()
            for part in _components(left):
                inside, head = set(part), min(part, key=lambda n: (depth[n], n))
                cut |= {(n, head) for n in part if head in left[n]}
                todo.append({n: [m for m in left[n] if m in inside and m != head] for n in part})
        return cls(set(starts), {n: [m for m in on.get(n, ()) if (n, m) not in cut] for n in depth}, sorted(cut))

    def nodes(self) -> Iterator[tuple]:
        """(node, level, ways, first, start) as ``Levels.lists`` has them."""
        waits, before = {n: len(ways) for n, ways in self.kept.items()}, defaultdict(list)
        for n, ways in self.kept.items():
            for m in ways:
                before[m].append(n)
        lost = {a for a, _ in self.cut}
        ready, open_, known = [n for n, w in waits.items() if not w], set(), {}
        for n in ready:
            ways = self.kept[n]
            if not ways:
                known[n] = (0, 1)
                if n not in lost:
                    open_.add(n)
            else:
                tips = [m for m in ways if m in open_]
                if tips:
                    open_.add(n)
                told = tips or ways
                known[n] = (1 + max(known[m][0] for m in told), sum(known[m][1] for m in told))
            for p in before[n]:
                waits[p] -= 1
                if not waits[p]:
                    ready.append(p)
        shut = [m for n in open_ for m in self.kept[n] if m not in open_]
        seen = set(shut)
        for n in shut:
            new = [m for m in self.kept[n] if m not in seen]
            seen.update(new)
            shut += new
        for n, (level, ways) in known.items():
            first = min((known[p][0] for p in before[n]), default=None)
            yield n, None if n in seen else level, None if n in seen else str(ways), first, n in self.starts

    def loops(self) -> Iterator[tuple]:
        """(src, dst, node) as ``Levels.cycles`` has them."""
        before = defaultdict(list)
        for n, ways in self.kept.items():
            for m in ways:
                before[m].append(n)
        for src, dst in self.cut:
            back, stack = {src}, [src]
            while stack:
                n = stack.pop()
                if n != dst:
                    new = [m for m in before[n] if m not in back]
                    back.update(new)
                    stack += new
            led, stack = {dst} & back, [n for n in [dst] if n in back]
            while stack:
                new = [m for m in self.kept[stack.pop()] if m in back and m not in led]
                led.update(new)
                stack += new
            yield from ((src, dst, n) for n in led)


def _small(take):
    """For each group of rows (kind, a, b), edges of kind 0 and starts of kind 1, what ``take`` has of its levels."""

    def run(_, rows: list[tuple]) -> Iterable[tuple]:
        return take(SmallLevels.of([(a, b) for kind, a, b in rows if not kind], {a for kind, a, _ in rows if kind}))

    return run


@dataclass(frozen=True)
class Levels:
    """What walks from the starts come to. ``lists`` (head, n, tail, level, ways, first: the lowest level of a list that leads here, start) are unforked stretches, level and ways those of their tail; ``nodes``
    (node, head, pos); ``kept`` and ``cut`` (src, dst) steps between lists, from heads to heads."""

    lists: DataFrame
    members: DataFrame
    kept: DataFrame
    cut: DataFrame
    loops: DataFrame | None = None  # of parts whose cycles need no rounds; all lists are single nodes then

    def nodes(self) -> DataFrame:
        """(node, level, ways): tips have level 0, others one more than their highest child; ways counts the paths to tips."""
        if self.loops is not None:
            return self.lists.select(F.col("head").alias("node"), F.col("level").cast("int").alias("level"), "ways")
        return self.members.join(self.lists.select("head", "n", "level", "ways"), "head").select("node", (F.col("level") + F.col("n") - 1 - F.col("pos")).cast("int").alias("level"), "ways")

    def max_paths(self) -> DataFrame:
        """(max_paths, a decimal): the paths from starts that no kept step leads to, to tips."""
        return self.lists.where("start and first is null").agg(F.coalesce(F.sum("ways"), F.lit(0)).cast("decimal(38,0)").alias("max_paths"))

    def min_paths(self) -> DataFrame:
        """(min_paths): the greatest number of nodes alive at a level; a node lives from its level until its first parent comes."""
        known = self.lists.where("level is not null")
        gone = known.where("first is not null").select(F.col("first").alias("level"), F.lit(-1).alias("d"))
        change = known.select("level", F.lit(1).alias("d")).unionByName(gone).groupBy("level").agg(F.sum("d").alias("d"))
        live = change.select(F.sum("d").over(Window.orderBy("level")).alias("live"))  # a row a level at which a list begins or ends
        return live.agg(F.coalesce(F.max("live"), F.lit(0)).cast("long").alias("min_paths"))

    def cycles(self, rounds: int = 10_000) -> DataFrame:
        """(src, dst, node): for each step that was cut (from node src to node dst) the nodes of its loop: dst, and what leads to src without passing it."""
        if self.loops is not None:
            return self.loops
        tails = self.lists.select(F.col("head").alias("_h"), "tail")
        back = self.kept.select(F.col("dst").alias("_at"), F.col("src").alias("_to"))
        near = written(self.cut.select("src", "dst", F.col("src").alias("head")), "cycles")
        parts = [near]
        for _ in range(rounds):
            if _empty(near):
                break
            on = near.where("head != dst").join(back, F.col("head") == F.col("_at")).select("src", "dst", F.col("_to").alias("head")).distinct()
            for p in parts:
                on = on.join(p, ["src", "dst", "head"], "left_anti")
            near = written(on, "cycles")
            parts.append(near)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        # kept steps lead only forwards, so what comes to the cut from outside of the loop is let go: a loop's lists are those that its head leads to
        down = spread_within(self.kept, rows)
        out = down.join(self.members, "head").join(tails, F.col("src") == F.col("_h"))
        return out.select(F.col("tail").alias("src"), "dst", "node")


def spread_within(kept: DataFrame, rows: DataFrame, rounds: int = 10_000) -> DataFrame:
    """The rows (src, dst, head) whose head can be come to from dst by kept steps among the rows of the same (src, dst)."""
    rows = written(rows, "loops")
    front = written(rows.where("head = dst"), "loops-front")
    parts = [front]
    for _ in range(rounds):
        on = front.join(kept.select(F.col("src").alias("head"), F.col("dst").alias("_to")), "head").select("src", "dst", F.col("_to").alias("head")).distinct()
        on = on.join(rows, ["src", "dst", "head"], "left_semi")
        for p in parts:
            on = on.join(p, ["src", "dst", "head"], "left_anti")
        front = written(on, "loops-front")
        if _empty(front):
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class BothLevels(Levels):
    """Levels of parts that fit a task, and of those in rounds."""

    rest: Levels | None = None

    def nodes(self) -> DataFrame:
        return self.lists.join(self.rest.lists.select("head"), "head", "left_anti").select(F.col("head").alias("node"), F.col("level").cast("int").alias("level"), "ways").unionByName(self.rest.nodes())

    def cycles(self, rounds: int = 10_000) -> DataFrame:
        return self.loops.unionByName(self.rest.cycles(rounds))


def levels(edges: DataFrame, starts: DataFrame, rounds: int = 10_000) -> Levels:
    """Levels of what walks from starts (column node) come to along edges (src, dst) of integers, cycles cut open. Connected parts of at most ``rounds`` nodes are solved in a task each, with many
    parts in a task's stream; larger ones in rounds of joins."""
    kind = edges.schema["src"].dataType.simpleString()
    parts, large = in_parts(edges, rounds, "levels")
    of = lambda df, node: df.join(parts.select(F.col("node").alias("_id"), "part"), F.col(node) == F.col("_id"), "left")
    none = F.lit(0).cast(kind)
    part = F.coalesce("part", F.col("src").cast("long"))  # what leads only to itself is on no part
    rows = of(edges, "src").select(part.alias("part"), F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").cast(kind).alias("b"))
    begin = of(starts.select("node"), "node").select(F.coalesce("part", F.col("node").cast("long")).alias("part"), F.lit(1).alias("kind"), F.col("node").cast(kind).alias("a"), none.alias("b"))
    rows = written(rows.unionByName(begin), "levels-rows")
    few = rows if large is None else rows.join(F.broadcast(large) if bounded(large, 10_000) else large, "part", "left_anti")
    lists = in_groups(few, _small(SmallLevels.nodes), f"head {kind}, level long, ways string, first long, start boolean")
    lists = lists.select("head", F.lit(1).cast("long").alias("n"), F.col("head").alias("tail"), "level", F.col("ways").cast("decimal(38,0)").alias("ways"), "first", "start")
    kept = in_groups(few, _small(lambda lv: ((n, m) for n, ways in lv.kept.items() for m in ways)), f"src {kind}, dst {kind}")
    cut = in_groups(few, _small(lambda lv: lv.cut), f"src {kind}, dst {kind}")
    loops = in_groups(few, _small(SmallLevels.loops), f"src {kind}, dst {kind}, node {kind}")
    members = lists.select(F.col("head").alias("node"), "head", F.lit(0).cast("long").alias("pos"))
    if large is None:
        return Levels(lists, members, kept, cut, loops)
    many = written(rows.join(large, "part", "left_semi"), "levels-many")
    rest = levels_in_rounds(many.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")), many.where("kind = 1").select(F.col("a").alias("node")), rounds)
    both = lambda x, y: x.unionByName(y.select(*x.columns))
    return BothLevels(both(lists, rest.lists), both(members, rest.members), both(kept, rest.kept), both(cut, rest.cut), loops, rest)


def levels_in_rounds(edges: DataFrame, starts: DataFrame, rounds: int = 10_000) -> Levels:
    """``levels`` in rounds of joins; nodes are of any type that has an order.

    A node all of whose ways on are cut has no level where another way leads to a tip: paths to it aren't counted. Where no tip can be come to at all, such nodes are the tips, so a ring
    has one path."""
    edges, starts = written(edges.select("src", "dst").distinct(), "levels-edges"), written(starts.select("node").distinct(), "levels-starts")
    single = lambda end, n: edges.groupBy(end).agg(F.count("*").alias("_n")).where("_n = 1").select(end)
    links = edges.join(single("src", 1), "src", "left_semi").join(single("dst", 1), "dst", "left_semi").join(starts.withColumnRenamed("node", "dst"), "dst", "left_anti")
    links = written(links.where("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), "levels-links")
    ranks = written(list_ranks(links, "levels"), "levels-ranks").where("not circular")  # what leads to no ring from outside isn't come to
    forked = edges.join(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"], "left_anti")
    of = ranks.select("node", "head")
    steps = forked.join(of.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("head", "src").alias("src"), "dst")
    steps = written(steps.distinct(), "levels-steps")  # a step leads to a list's first node
    size = ranks.groupBy("head").agg(F.count("*").alias("n"), F.max_by("node", "pos").alias("tail"))
    weighed = steps.join(size.select(F.col("head").alias("src"), F.col("n").alias("w")), "src", "left").select("src", "dst", F.coalesce("w", F.lit(1)).alias("w"))
    depths = written(spread(written(weighed, "levels-weighed"), starts.select("node", F.lit(0).cast("long").alias("value")), "levels-depths"), "levels-near")
    near = depths.select(F.col("node").alias("src"))
    steps = written(steps.join(near, "src", "left_semi"), "levels-inner")
    cut = written(_cut(steps, depths), "levels-cut")
    kept = written(steps.join(cut, ["src", "dst"], "left_anti"), "levels-kept")
    lists = depths.select(F.col("node").alias("head")).join(size, "head", "left").select("head", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("tail", "head").alias("tail"))
    lists = written(lists, "levels-lists")

    # solved lists tell their parents, which keep how many they still wait for; those that come to a tip count these alone
    none, one = F.lit(0).cast("long"), F.lit(1).cast("decimal(38,0)")
    needs = kept.groupBy(F.col("src").alias("head")).agg(F.count("*").alias("need"))
    lost = cut.select(F.col("src").alias("head")).distinct().withColumn("_cut", F.lit(True))
    zero = F.struct(none.alias("level"), F.lit(0).cast("decimal(38,0)").alias("ways"))
    end = F.struct(none.alias("level"), one.alias("ways"))
    rest = lists.join(needs, "head", "left").join(lost, "head", "left").select(
        "head", "n", F.coalesce("need", none).alias("need"), (F.col("need").isNull() & F.col("_cut").isNull()).alias("open"),
        F.when(F.col("need").isNull(), end).otherwise(zero).alias("to_tips"), F.when(F.col("need").isNull(), end).otherwise(zero).alias("to_ends"),
    )
    rest, seen = measured(rest, "levels-rest", n=F.count_if(F.col("need") == 0))
    solved = []
    for _ in range(rounds):
        if not seen["n"]:
            break
        ready = rest.where("need = 0").select("head", "n", "open", F.when(F.col("open"), F.col("to_tips")).otherwise(F.col("to_ends")).alias("v")).select("head", "n", "open", "v.*")
        solved.append(ready)
        top = ready.select(F.col("head").alias("dst"), F.col("open").alias("_o"), (F.col("level") + F.col("n")).alias("_l"), F.col("ways").alias("_w"))
        news = kept.join(top, "dst").select(F.col("src").alias("head"), "_o", "_l", "_w")
        nothing = F.lit(None)
        old = rest.where("need > 0").select("head", "n", "need", "open", "to_tips", "to_ends", *[nothing.alias(c) for c in ("_o", "_l", "_w")])
        news = news.select("head", *[nothing.alias(c) for c in ("n", "need", "open", "to_tips", "to_ends")], "_o", "_l", "_w")
        best = lambda x, o: F.struct(
            F.greatest(F.max(f"{x}.level"), F.max(F.when(o, F.col("_l")))).alias("level"), (F.max(f"{x}.ways") + F.coalesce(F.sum(F.when(o, F.col("_w"))), F.lit(0))).cast("decimal(38,0)").alias("ways")
        ).alias(x)
        heard = old.unionByName(news).groupBy("head").agg(
            F.max("n").alias("n"), (F.max("need") - F.count("_o")).alias("need"), (F.max("open") | F.coalesce(F.max("_o"), F.lit(False))).alias("open"), best("to_tips", F.col("_o")), best("to_ends", ~F.col("_o"))
        )
        rest, seen = measured(heard, "levels-rest", n=F.count_if(F.col("need") == 0))
    else:
        raise RuntimeError(_UNFINISHED)
    known = solved[0]
    for some in solved[1:]:
        known = known.unionByName(some)
    known = written(known, "levels-known")
    # a list whose ways on are all cut, beside others' that lead to a tip, has no level
    open_ = known.where("open").select("head")
    first = kept.join(known.select(F.col("head").alias("src"), F.col("level").alias("_p")), "src").groupBy(F.col("dst").alias("head")).agg(F.min("_p").alias("first"))
    beside = kept.join(open_.withColumnRenamed("head", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(open_.withColumnRenamed("head", "node"), "node", "left_anti")
    beside = written(beside.withColumn("value", F.lit(0)), "levels-beside")
    shut = beside if _empty(beside) else spread(kept, beside, "levels-shut")
    shut = shut.select(F.col("node").alias("head"), F.lit(True).alias("_shut"))
    rows = known.join(first, "head", "left").join(lists.select("head", "tail"), "head").join(shut, "head", "left").join(starts.select(F.col("node").alias("head"), F.lit(True).alias("_start")), "head", "left")
    out = rows.select("head", "n", "tail", F.when(F.col("_shut").isNull(), F.col("level")).alias("level"), F.when(F.col("_shut").isNull(), F.col("ways")).alias("ways"), "first", F.coalesce("_start", F.lit(False)).alias("start"))
    members = ranks.select("node", "head", "pos").join(lists.select("head"), "head", "left_semi")
    alone = lists.join(size.select("head"), "head", "left_anti").select(F.col("head").alias("node"), "head", F.lit(0).cast("long").alias("pos"))
    return Levels(written(out, "levels-found"), members.unionByName(alone), kept, cut)

