"""Conversation structure repair by lazy weighted determinisation.

The cheapest edits that give role initials ``(s?(ua)+)?`` are a shortest path through (rows read, state of that pattern). The four states' costs after some rows, less the
smallest of them, are one vector; vectors are the states of a deterministic automaton, found as rows ask for them and kept in a table (vector, symbol) -> (vector, added
cost). A row's symbol is its role's initial and whether it is truncated, or that it must go. States that are strictly dominated (start, more than
3 above "after an assistant"; "after a system", above it) are on no cheapest path and dropped, so there are few vectors. A scan of the table gives the
cost; backwards, the arcs that are tight (costs differ by just their weight) and lead to the end mark the states on cheapest paths; forwards, the
least letter of the tight arcs gives the ASCII-least audit, as state and letter decide where an edit leads.

Rows are sorted by ranges of (conversation, turn, role, text). A conversation that lies inside a range and isn't long is repaired as it streams by. The others, of
which a range has two or that exceed ``piece_rows`` or ``piece_bytes``, become pieces: each piece's effect on every vector, then on every set of marks, then on every
state is found by itself, and a fold over the pieces' effects (a narrow row a piece) gives each piece what comes into it. So a conversation with a
third of all rows is many tasks' work; only its audit, and the SHA-256 of its text, which can't be split, are put together in one place, from a row a piece.

Defined results: null role or text is one space, a null conversation is a conversation, null turns come first; rows of equal turn are taken by role, then text; a row's role
counts by its first character, s, u or a; repeated rows are duplicates of their first; rows that aren't ``present`` only name their conversation; a conversation
without rows has zeros and empty texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import clustered, parallelism, text_batches, written

# fixed values of the task: edits' costs, the pattern's states (0 start, 1 after s, 2 after u, 3 after a) and spaces
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}  # where an inserted or reroled row leads
ACCEPTS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
INITIALS = "sua-"
GONE = 8  # the symbol of rows that must go; others are twice the initial's number, and 1 more where truncated

_NEVER = 1 << 40


class Automaton:
    """Deterministic states are numbers of normalised cost vectors, found on demand."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table: dict[tuple, tuple[int, int]] = {}
        self._back: dict[tuple, int] = {}
        self._ahead: dict[tuple, tuple[str, int]] = {}
        self._named([0, _NEVER, _NEVER, _NEVER])

    def _named(self, costs: list[int]) -> tuple[int, int]:
        for _ in range(2):
            for q, to in GIVEN.items():
                costs[to] = min(costs[to], costs[q] + INSERT)
        if costs[0] > costs[3] + DELETE:
            costs[0] = _NEVER
        if costs[1] > costs[3]:
            costs[1] = _NEVER
        least = min(costs)
        vector = tuple(c - least if c < _NEVER else _NEVER for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def arcs(symbol: int) -> list[tuple[str, int, int, int]]:
        """(letter, from, to, cost) of the edits of a row, by letter."""
        out = [("D", q, q, DELETE) for q in GIVEN]
        if symbol != GONE:
            more = TRUNCATED * (symbol & 1)
            out += [("K", q, to, more) for q, to in KEEPS.get(INITIALS[symbol >> 1], {}).items()]
            out += [("R", q, to, REROLE + more) for q, to in GIVEN.items()]
        return out

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if (state, symbol) not in self.table:
            costs, new = self.vectors[state], [_NEVER] * 4
            for _, q, to, cost in self.arcs(symbol):
                new[to] = min(new[to], costs[q] + cost)
            self.table[state, symbol] = self._named([min(c, _NEVER) for c in new])
        return self.table[state, symbol]

    def completed(self) -> Automaton:
        """With all vectors, numbered alike everywhere."""
        at = 0
        while at < len(self.vectors):
            for symbol in range(GONE + 1):
                self.step(at, symbol)
            at += 1
        return self

    def _with_inserts(self, state: int, marks: int) -> int:
        costs = self.vectors[state]
        for _ in range(2):
            for q, to in GIVEN.items():
                if marks >> to & 1 and costs[q] + INSERT == costs[to]:
                    marks |= 1 << q
        return marks

    def last(self, state: int) -> tuple[int, int]:
        """(cost, marks) at the end: the states from which cheapest edits end here."""
        costs = self.vectors[state]
        least = min(costs[q] for q in ACCEPTS)
        return least, self._with_inserts(state, sum(1 << q for q in ACCEPTS if costs[q] == least))

    def back(self, state: int, symbol: int, marks: int) -> int:
        """Marks ahead of a row, from those behind it."""
        key = state, symbol, marks
        if key not in self._back:
            (to_state, least), costs = self.step(state, symbol), self.vectors[state]
            behind, found = self.vectors[to_state], 0
            for _, q, to, cost in self.arcs(symbol):
                if marks >> to & 1 and costs[q] < _NEVER and costs[q] + cost == behind[to] + least:
                    found |= 1 << q
            self._back[key] = self._with_inserts(state, found)
        return self._back[key]

    def ahead(self, state: int, symbol: int, marks: int, q: int) -> tuple[str, int]:
        """(letters, state) of the least cheapest edits from q up to and with a row; ``marks`` are those behind it."""
        key = state, symbol, marks, q
        if key not in self._ahead:
            (to_state, least), costs = self.step(state, symbol), self.vectors[state]
            behind, here, letters, at = self.vectors[to_state], self.back(state, symbol, marks), "", q
            while True:
                fits = {letter: to for letter, p, to, cost in self.arcs(symbol) if p == at and marks >> to & 1 and costs[p] + cost == behind[to] + least}
                if here >> GIVEN[at] & 1 and costs[at] + INSERT == costs[GIVEN[at]]:
                    fits["I"] = GIVEN[at]
                letter = min(fits)
                letters, at = letters + letter, fits[letter]
                if letter != "I":
                    break
            self._ahead[key] = letters, at
        return self._ahead[key]

    def end(self, state: int, q: int) -> str:
        """The inserts that end the cheapest edits."""
        costs, letters = self.vectors[state], ""
        while q not in ACCEPTS or costs[q] != self.last(state)[0]:
            q, letters = GIVEN[q], letters + "I"
        return letters

    def scan(self, symbols: bytes, state: int = 0) -> tuple[list[int], int]:
        """(state ahead of each row and at the end, cost added)."""
        path, cost = [state], 0
        for s in symbols:
            state, more = self.step(state, s)
            path.append(state)
            cost += more
        return path, cost

    def marked(self, symbols: bytes, path: list[int], marks: int) -> list[int]:
        """Marks ahead of each row and at the end, where they are given."""
        out = [marks]
        for state, s in zip(reversed(path[:-1]), reversed(symbols)):
            marks = self.back(state, s, marks)
            out.append(marks)
        return out[::-1]

    def edits(self, symbols: bytes, path: list[int], marks: list[int], q: int) -> tuple[list[str], int]:
        """The letters of each row, inserts ahead of it first, and the state at the end."""
        out = []
        for state, s, m in zip(path, symbols, marks[1:]):
            letters, q = self.ahead(state, s, m, q)
            out.append(letters)
        return out, q


def _applied(letters: list[str], end: str, q: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from state q on."""
    out_r, out_t = [], []
    for some, role, text in zip([*letters, end], [*roles, None], [*texts, None]):
        for letter in some:
            if letter == "D":
                continue
            if letter == "K":
                q = KEEPS[role[0]][q]
                out_r.append(role)
            else:
                q = GIVEN[q]
                out_r.append(ROLES[q])
            out_t.append("" if letter == "I" else text)
    return out_r, out_t


def _symbol(role: str, text: str) -> int:
    """The symbol of a row that nothing precedes."""
    end = text.rstrip(SPACE)
    return 2 * INITIALS.index(_initials([role])) + (end[-1] not in ".!?") if end else GONE


def _initials(roles: list[str]) -> str:
    return "".join(r[0] if r and r[0] in KEEPS else "-" for r in roles)


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


_STREAM = "part int, no long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<long>, roles array<string>, texts array<string>, symbols binary, initials string"


def _stream(piece_rows: int, piece_bytes: int, kind: pa.DataType):
    schema = pa.schema(
        [("conv", kind), ("part", pa.int32()), ("no", pa.int64()), ("whole", pa.bool_())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("symbols", pa.binary()), ("initials", pa.string())]
    )
    auto = Automaton()

    def whole(conv, turns, roles, texts) -> tuple:
        symbols, seen, blank, duplicate, truncated = bytearray(), set(), 0, 0, 0
        for role, text in zip(roles, texts):
            s = _symbol(role, text)
            if s == GONE:
                blank += 1
            elif (role, text) in seen:
                duplicate, s = duplicate + 1, GONE
            elif s & 1:
                truncated += 1
            seen.add((role, text))
            symbols.append(s)
        path, cost = auto.scan(symbols)
        more, marks = auto.last(path[-1])
        letters, q = auto.edits(symbols, path, auto.marked(symbols, path, marks), 0)
        end = auto.end(path[-1], q)
        known = {t for t in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        new = _applied(letters, end, 0, roles, texts)
        return conv, True, gaps, blank, duplicate, truncated, _illegal(_initials(roles)), cost + more, "".join(letters) + end, None, *new, None, None

    def raw(conv, turns, roles, texts) -> tuple:
        return conv, False, *[None] * 7, turns, roles, texts, bytes(_symbol(r, t) for r, t in zip(roles, texts)), _initials(roles)

    def run(batches):
        part, no, held, size = TaskContext.get().partitionId(), 0, [], 0
        now, first, broken, turns, roles, texts, bytes_ = None, True, False, [], [], [], 0

        def put(row: tuple) -> None:
            nonlocal no, size
            held.append((row[0], part, no, *row[1:]))
            no, size = no + 1, size + bytes_ + 64

        def out() -> pa.RecordBatch:
            nonlocal held, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
            return batch

        for batch in batches:
            for conv, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        put((raw if first or broken else whole)(now[0], turns, roles, texts))
                        first = False
                    now, broken, turns, roles, texts, bytes_ = (conv,), False, [], [], [], 0
                elif len(roles) >= piece_rows or bytes_ >= piece_bytes:
                    put(raw(conv, turns, roles, texts))
                    broken, turns, roles, texts, bytes_ = True, [], [], [], 0
                if present:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    bytes_ += len(text) + 32
                if size >= piece_bytes:
                    yield out()
        if now is not None:
            put(raw(now[0], turns, roles, texts))  # the next range may hold more of it
            yield out()

    return run


def _effects(batches):
    """Symbols of a piece with its duplicates, counts, and where each vector leads at which cost."""
    auto = Automaton().completed()
    n = len(auto.vectors)
    to = np.array([[auto.table[v, s][0] for s in range(GONE + 1)] for v in range(n)])
    more = np.array([[auto.table[v, s][1] for s in range(GONE + 1)] for v in range(n)])
    for batch in batches:
        rows = []
        for part, no, symbols, firsts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            s = np.frombuffer(symbols, np.uint8)
            new = np.zeros(len(s), bool)
            new[np.array(firsts or [], int)] = True
            kept = np.where(new, s, GONE).astype(np.uint8)
            state, cost = np.arange(n), np.zeros(n, np.int64)
            for x in kept.tolist():
                cost += more[state, x]
                state = to[state, x]
            blank = int((s == GONE).sum())
            rows.append((part, no, kept.tobytes(), blank, int((kept == GONE).sum()) - blank, int(((kept != GONE) & (kept & 1 == 1)).sum()), state.tolist(), cost.tolist()))
        cols = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)], batch.column(5)], ["conv", "part", "no", "symbols", "blank", "duplicate", "truncated", "leads", "costs", "initials"])


def _fold_vectors(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vector ahead of each piece of a conversation, and on its last piece the conversation's counts, cost and marks."""
    pdf = pdf.sort_values(["part", "no"])
    auto, state, cost, states, illegal, ahead = Automaton().completed(), 0, 0, [], 0, ""
    for leads, costs, ends, inner in zip(pdf.leads, pdf.costs, pdf.ends, pdf.illegal):
        states.append(state)
        state, cost = int(leads[state]), cost + int(costs[state])
        if ends:
            illegal += int(inner) + (bool(ahead) and ahead + ends[0] not in LEGAL)
            ahead = ends[-1]
    more, marks = auto.last(state)
    none = [None] * (len(pdf) - 1)
    out = {"conv": pdf.conv.iloc[0], "part": pdf.part, "no": pdf.no, "state": states}
    out |= {c: none + [int(pdf[c].sum())] for c in ("blank", "duplicate", "truncated")}
    out |= {"illegal": none + [illegal], "cost": none + [cost + more], "marks": none + [marks]}
    return pd.DataFrame(out)


def _fold(backwards: bool, column: str, first: str | None):
    """What comes into each piece, from what every value leads to (``leads``) in the pieces before it, or behind it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "no"], ascending=not backwards)
        at = int(pdf[first].iloc[0]) if first else 0
        got = []
        for leads in pdf.leads:
            got.append(at)
            at = int(leads[at])
        return pd.DataFrame({"part": pdf.part, "no": pdf.no, column: got})

    return run


def _mark_effects(batches):
    auto = Automaton().completed()
    for batch in batches:
        leads = []
        for symbols, state in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            path, _ = auto.scan(symbols, state)
            leads.append([auto.marked(symbols, path, m)[0] for m in range(16)])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 5)), pa.array(leads, pa.list_(pa.int32()))], ["conv", "part", "no", "marks", "leads"])


def _state_effects(batches):
    auto = Automaton().completed()
    for batch in batches:
        leads = []
        for symbols, state, behind in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            path, _ = auto.scan(symbols, state)
            marks = auto.marked(symbols, path, behind)
            leads.append([auto.edits(symbols, path, marks, q)[1] if marks[0] >> q & 1 else -1 for q in range(4)])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), pa.array(leads, pa.list_(pa.int32()))], ["conv", "part", "no", "leads"])


def _rewritten(batches):
    """Edits, roles and texts of pieces; the last piece of a conversation ends its edits."""
    auto = Automaton().completed()
    for batch in batches:
        audits, roles, texts = [], [], []
        for r, t, symbols, state, behind, q, last in zip(*(batch.column(i).to_pylist() for i in range(3, 10))):
            path, _ = auto.scan(symbols, state)
            letters, to = auto.edits(symbols, path, auto.marked(symbols, path, behind), q)
            end = auto.end(path[-1], to) if last else ""
            new = _applied(letters, end, q, r, t)
            audits.append("".join(letters) + end)
            roles.append(new[0])
            texts.append(new[1])
        texts_ = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), pa.array(audits, pa.string()), pa.array(roles, texts_), pa.array(texts, texts_)], ["conv", "part", "no", "audit", "roles", "texts"])


def repaired(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None,
    piece_rows: int = 1 << 14, piece_bytes: int = 1 << 22,
) -> tuple[DataFrame, DataFrame]:
    """(found, pieces): found has a row for each conversation (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); pieces hold the repaired rows in the order of
    (part, no): (conv, part, no, several, roles, texts), ``several`` where a conversation has more than one."""
    spark = turns.sparkSession
    text_batches(spark)
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), (F.col(present_col) if present_col else F.lit(True)).alias("present"),
    )
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), *keys, "_row").sortWithinPartitions(*keys).drop("_row")
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    held = written(placed.mapInArrow(_stream(piece_rows, piece_bytes, to_arrow_type(rows.schema["conv"].dataType)), f"{conv}, {_STREAM}"), "t12-stream")
    done, raw = held.where("whole"), held.where("not whole")

    cell = raw.select("conv", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r"))
    firsts = cell.groupBy("conv", F.col("r.roles").alias("role"), F.sha2("r.texts", 256).alias("digest")).agg(F.min(F.struct("part", "no", "pos")).alias("f"))
    firsts = firsts.groupBy(F.col("f.part").alias("part"), F.col("f.no").alias("no")).agg(F.collect_list("f.pos").alias("firsts"))  # at most a piece's rows
    narrow = raw.select("conv", "part", "no", "symbols", "initials").join(firsts, ["part", "no"], "left").select("conv", "part", "no", "symbols", "firsts", "initials")
    effects = written(
        narrow.mapInArrow(_effects, f"{conv}, part int, no long, symbols binary, blank long, duplicate long, truncated long, leads array<int>, costs array<long>, initials string"), "t12-effects"
    )
    pairs = F.expr(f"size(filter(sequence(1, greatest(length(initials) - 1, 1)), i -> length(initials) > 1 and not array_contains(array({', '.join(repr(x) for x in sorted(LEGAL))}), substr(initials, i, 2))))")
    ends = F.concat(F.expr("left(initials, 1)"), F.expr("right(initials, 1)"))
    folded = effects.select("conv", "part", "no", "blank", "duplicate", "truncated", "leads", "costs", ends.alias("ends"), pairs.alias("illegal"))
    counts = "blank long, duplicate long, truncated long, illegal long, cost long"
    vectors = written(folded.groupBy("conv").applyInPandas(_fold_vectors, f"{conv}, part int, no long, state int, {counts}, marks int"), "t12-vectors")
    known = effects.select("conv", "part", "no", "symbols").join(vectors.select("part", "no", "state", "marks"), ["part", "no"]).select("conv", "part", "no", "symbols", "state", "marks")
    marks = known.mapInArrow(_mark_effects, f"{conv}, part int, no long, marks int, leads array<int>")
    marks = written(marks.groupBy("conv").applyInPandas(_fold(True, "behind", "marks"), "part int, no long, behind int"), "t12-marks")
    known = known.join(marks, ["part", "no"]).select("conv", "part", "no", "symbols", "state", "behind", F.col("marks").isNotNull().alias("last"))
    states = known.drop("last").mapInArrow(_state_effects, f"{conv}, part int, no long, leads array<int>")
    states = states.groupBy("conv").applyInPandas(_fold(False, "q", None), "part int, no long, q int")
    known = known.join(states, ["part", "no"]).drop("conv")
    pieces = raw.select("conv", "part", "no", "roles", "texts").join(known, ["part", "no"]).select("conv", "part", "no", "roles", "texts", "symbols", "state", "behind", "q", "last")
    pieces = written(pieces.mapInArrow(_rewritten, f"{conv}, part int, no long, audit string, roles array<string>, texts array<string>"), "t12-pieces")

    audits = pieces.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.count("*").alias("pieces"))
    when = raw.select("conv", F.explode("turns").alias("t")).groupBy("conv").agg((F.max("t") - F.min("t") + 1 - F.count_distinct("t")).alias("gaps"))
    null_safe = lambda a, b: a.join(b.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
    several = null_safe(null_safe(vectors.where("marks is not null").select("conv", *["blank", "duplicate", "truncated", "illegal", "cost"]), audits), when)
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    found = done.select(*names).unionByName(several.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).select(*names))
    out = done.select("conv", "part", "no", F.lit(False).alias("several"), "roles", "texts").unionByName(pieces.select("conv", "part", "no", F.lit(True).alias("several"), "roles", "texts"))
    return found, out


def _hashed(kind: pa.DataType):
    """(conv, digest) of the lines of conversations whose pieces come in order: bytes are fed as they come."""

    def run(batches):
        now, h, any_ = None, None, False
        convs, digests = [], []
        for batch in batches:
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        convs.append(now[0])
                        digests.append(h.hexdigest())
                    now, h, any_ = (conv,), hashlib.sha256(), False
                if lines is not None:
                    h.update((b"\n" if any_ else b"") + lines.encode())
                    any_ = True
        if now is not None:
            convs.append(now[0])
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], ["conv", "repaired_sha256"])

    return run


def line_digests(pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of each conversation's ``role:text`` lines."""
    kind = pieces.schema["conv"].dataType
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    one = pieces.where("not several").select("conv", F.sha2(lines, 256).alias("repaired_sha256"))
    many = pieces.where("several").select("conv", "part", "no", F.when(F.size("roles") > 0, lines).alias("lines"))
    many = clustered(many, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "no").select("conv", "lines")
    return one.unionByName(many.mapInArrow(_hashed(to_arrow_type(kind)), f"conv {kind.simpleString()}, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows emptied, without full stops, repeated, of another role, or only naming their conversation, by a CRC-32 of conversation and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")), F.lit(20))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("fault") == 0, "").otherwise(text).alias("text"), (F.col("fault") != 0).alias("present"),
        F.explode(F.expr("sequence(1, if(fault = 3, 2, 1))")).alias("copy"),
    )
    return rows.drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pieces = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present_col="present")
    digests = line_digests(pieces).withColumnRenamed("conv", "_c")
    return found.join(digests, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c").withColumnRenamed("conv", "conv_id")
