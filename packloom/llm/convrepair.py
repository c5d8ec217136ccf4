"""Repair of the structure of conversations by weighted finite-state composition.

A conversation's rows are a chain acceptor. An edit transducer keeps a row, gives it
another role, deletes it or inserts an empty one; a grammar acceptor takes the role
initials ``(s?(ua)+)?``. The three are composed lazily: only states that a path can
reach are made, and what a row does to the costs of the states behind it is kept by
the row's kind, as there are few. Weights are pairs of a cost and the string of edit
initials, in lexicographic order. The shortest path is found in topological order from
the end: where a row ends, the state is one of the grammar's four, so the costs of four
states are all that is carried. Different edits out of a state have different initials,
so the least string is the one that takes the least initial wherever costs are equal.

On Spark, rows that agree in everything are counted first. Rows are numbered by range
over (conversation, turn, role, text), and a conversation is cut into fragments of a
bounded number of narrow rows. One pass streams the fragments from the end and notes
what every entry state would do, the other streams them from the start and follows the
path. Both carry four costs or one state, never a conversation. Texts meet the edits by
row number. ``summaries`` also streams the repaired lines through SHA-256, which can
only be computed in order.

Defined results: a null role or text is one space; rows are taken by turn, nulls first,
then by role, text; a null conversation is a conversation; an empty role has no initial;
a conversation without rows (all of them damaged away) has zeros, an empty audit and the
digest of the empty string; equal rows are copies, the first is judged and the others
are duplicates; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.runtime import materialise, prepare, renamed

#: Rows of a fragment, at most, as a power of two.
FRAGMENT_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The grammar acceptor: arcs by state and role initial, and the states where it may end.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = 4
#: Insertions after one another. Two reach every state that more would reach.
INSERTIONS = 2
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
SPACE = " "


def edits(initial: str | None, flag: str, inserted: int):
    """Arcs of the edit transducer: (label, cost, code, output, insertions so far).

    ``initial`` is the row's role initial, None behind the last row; ``flag`` is ``x``
    for a row that has to go, ``t`` for a truncated one, else ``k``. The code tells
    what a label did: ``U``, ``A`` inserted, ``u``, ``a`` given that role, ``k`` kept,
    ``d`` deleted.
    """
    if inserted < INSERTIONS:
        for role in "ua":
            yield "I", INSERT, role.upper(), role, inserted + 1
    if initial is not None:
        yield "D", DELETE, "d", "", 0
        if flag != "x":
            cost = TRUNCATED if flag == "t" else 0
            yield "K", KEEP + cost, "k", initial, 0
            for role in "ua":
                yield "R", REROLE + cost, role, role, 0


class Machine:
    """Shortest paths through the composition, one row at a time, from the end."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def step(self, initial: str | None, flag: str, after: tuple[int, ...]):
        """Of each grammar state before a row: its cost, the codes of the edits up to
        and with this row, and the state behind it. ``after``: the costs there."""
        least = min(after)
        key = (initial, flag, tuple(a - least for a in after))
        if key not in self.known:
            self.known[key] = self._compose(*key)
        cost, codes, exits = self.known[key]
        return tuple(least + c for c in cost), codes, exits

    def _compose(self, initial, flag, after):
        best: dict[tuple[int, int], tuple] = {}

        def shortest(inserted: int, state: int) -> tuple:
            """(cost, codes, state behind the row), of the least (cost, labels)."""
            if (inserted, state) not in best:
                paths = [(after[state], "", "", state)] if initial is None else []
                for label, cost, code, output, then in edits(initial, flag, inserted):
                    to = GRAMMAR.get((state, output)) if output else state
                    if to is None:
                        continue
                    if then:
                        more, codes, at = shortest(then, to)
                        paths.append((cost + more, label, code + codes, at))
                    else:
                        paths.append((cost + after[to], label, code, to))
                cost, _, codes, at = min(paths)
                best[inserted, state] = (cost, codes, at)
            return best[inserted, state]

        found = [shortest(0, s) for s in range(STATES)]
        return tuple(f[0] for f in found), tuple(f[1] for f in found), tuple(f[2] for f in found)


def _streamed(df: DataFrame, conv: str, order: list[Column], run, schema: str) -> DataFrame:
    return df.repartition(conv).sortWithinPartitions(F.asc(conv), *order).mapInArrow(run, schema)


def _backward(conv_type: str):
    """Fragments from a conversation's end: what each entry state would do."""
    start = tuple(0 if s in FINAL else FAR for s in range(STATES))

    def run(batches):
        machine, current, after = Machine(), (), start
        for b in batches:
            out = []
            for conv, frag, rows in zip(*(b.column(n).to_pylist() for n in ("conv", "frag", "rows"))):
                tail = None
                if current != (conv,):
                    current = (conv,)
                    after, ends, _ = machine.step(None, "k", start)
                    tail = list(ends)
                steps = []
                for r in reversed(rows):
                    more = DELETE * (r["copies"] - 1)
                    after, codes, exits = machine.step(r["initial"] if r["initial"] in ("s", "u", "a", "") else "?", r["flag"], after)
                    after = tuple(a + more for a in after)
                    steps.append((codes, exits))
                ways, exits = [], []
                for state in range(STATES):
                    codes = []
                    for code, to in reversed(steps):
                        codes.append(code[state])
                        state = to[state]
                    ways.append(",".join(codes))
                    exits.append(state)
                out.append((conv, frag, ways, exits, tail, after[0]))
            if out:
                kinds = [b.column("conv").type, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["conv", "frag", "ways", "exits", "tail", "cost"])

    return run, f"conv {conv_type}, frag long, ways array<string>, exits array<int>, tail array<string>, cost long"


_LABELS = str.maketrans("UAuakd", "IIRRKD")


def _forward(conv_type: str):
    """Fragments from a conversation's start: the codes of its rows, and with the last
    one its audit, cost and illegal neighbours."""

    def run(batches):
        current, state, audit, cost, illegal, last = (), 0, [], 0, 0, None
        for b in batches:
            out = []
            for conv, frag, rows, ways, exits, tail, total in zip(*(b.column(n).to_pylist() for n in ("conv", "frag", "rows", "ways", "exits", "tail", "cost"))):
                if current != (conv,):
                    current, state, audit, cost, illegal, last = (conv,), 0, [], total, 0, None
                codes = ways[state].split(",")
                for code, r in zip(codes, rows):
                    audit.append(code.translate(_LABELS) + "D" * (r["copies"] - 1))
                    first = r["initial"]
                    illegal += (last is not None and last + first not in ("su", "ua", "au")) + r["copies"] - 1
                    last = first
                state = exits[state]
                if tail is not None:
                    codes.append(tail[state])
                    audit.append(tail[state].translate(_LABELS))
                    out.append((conv, frag, codes, "".join(audit), cost, illegal))
                else:
                    out.append((conv, frag, codes, None, None, None))
            if out:
                kinds = [b.column("conv").type, pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["conv", "frag", "codes", "audit", "cost", "illegal"])

    return run, f"conv {conv_type}, frag long, codes array<string>, audit string, cost long, illegal long"


def _digests(conv_type: str):
    """SHA-256 of each conversation's lines, joined by newlines."""

    def run(batches):
        current, hashed, some = (), None, False
        for b in batches:
            done = []
            for conv, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist()):
                if current != (conv,):
                    if hashed is not None:
                        done.append((current[0], hashed.hexdigest()))
                    current, hashed, some = (conv,), hashlib.sha256(), False
                hashed.update(("\n" if some else "").encode() + line.encode())
                some = True
            kind = b.schema.field("conv").type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["conv", "sha"])
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current[0]], kind), pa.array([hashed.hexdigest()], pa.string())], names=["conv", "sha"])

    return run, f"conv {conv_type}, sha string"


class Repair:
    """Faults and cheapest edits of conversations."""

    def __init__(self, df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        prepare(df.sparkSession)
        work, _, (c, t, r, x) = renamed(df, conv, turn, role, text)
        rows = work.select(F.col(c).alias("conv"), F.col(t).alias("turn"), F.coalesce(r, F.lit(SPACE)).alias("role"), F.coalesce(x, F.lit(SPACE)).alias("text"))
        core = F.rtrim("text", F.lit(BLANKS))
        look = F.when(core == "", "blank").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
        #: Rows with their texts, told apart by ``same``. All else is done without texts.
        self.texts = rows.withColumn("same", F.sha2("text", 256))
        narrow = self.texts.select("conv", "turn", "role", "same", F.left("text", F.lit(100)).alias("start"), look.alias("look"))
        copies = narrow.groupBy("conv", "turn", "role", "same").agg(F.count("*").alias("copies"), F.first("start").alias("start"), F.first("look").alias("look"))
        first = copies.groupBy("conv", "role", "same").agg(F.min(F.struct("turn")).alias("first"))
        a, b = copies.alias("a"), first.alias("b")
        met = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.same") == F.col("b.same"))).select("a.*", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"))
        fault = F.when(F.col("look") == "blank", "blank").when(F.col("seen"), "duplicate").otherwise(F.col("look"))
        order = ["conv", "turn", "role", "start", "same"]
        numbered = met.withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
        self.kind = dict(work.dtypes)[c]
        #: Different rows, in order of ``pos``, with their copies and first faults.
        self.rows = materialise(numbered.select("pos", "conv", "turn", "role", "same", "copies", "fault"), "turns")
        flag = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("k")
        narrow = F.struct("pos", F.left("role", F.lit(1)).alias("initial"), flag.alias("flag"), "copies")
        frags = self.rows.groupBy("conv", F.shiftright("pos", FRAGMENT_BITS).alias("frag")).agg(F.sort_array(F.collect_list(narrow)).alias("rows"))
        frags = materialise(frags, "fragments")
        back = _streamed(frags, "conv", [F.desc("frag")], *_backward(self.kind))
        both = frags.alias("f").join(back.alias("w"), F.col("f.conv").eqNullSafe(F.col("w.conv")) & (F.col("f.frag") == F.col("w.frag"))).select("f.conv", "f.frag", "f.rows", "w.ways", "w.exits", "w.tail", "w.cost")
        path = _streamed(both, "conv", [F.asc("frag")], *_forward(self.kind))
        a, b = path.alias("p"), frags.alias("f")
        #: Codes by fragment, one a row and one for the end; the last has the totals.
        self.paths = materialise(a.join(b, F.col("p.conv").eqNullSafe(F.col("f.conv")) & (F.col("p.frag") == F.col("f.frag"))).select("p.*", F.transform("f.rows", lambda r: r["pos"]).alias("pos")), "paths")

    def lines(self) -> DataFrame:
        """DataFrame[conv, pos, at, role, text]: the repaired rows, in order of pos, at."""
        own = self.paths.select(F.explode(F.arrays_zip("pos", F.slice("codes", 1, F.size("pos")).alias("code"))).alias("x")).select("x.pos", "x.code")
        end = self.paths.where("audit IS NOT NULL").select(F.element_at("pos", -1).alias("pos"), F.element_at("codes", -1).alias("tail"))
        told = own.join(end, "pos", "left").withColumn("code", F.concat("code", F.coalesce("tail", F.lit(""))))
        at = self.rows.join(told.select("pos", "code"), "pos").where(F.length(F.replace("code", F.lit("d"), F.lit(""))) > 0)
        # Equal rows are one before they meet their place, however many there are.
        one_each = self.texts.groupBy("conv", "turn", "role", "same").agg(F.first("text").alias("text"))
        a, b = at.alias("a"), one_each.alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("conv", "turn")] + [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("role", "same")]
        every = a.join(b, reduce(Column.__and__, same)).select("a.conv", "a.pos", "a.role", "a.code", "b.text")
        one = every.select("conv", "pos", "role", "text", F.posexplode(F.split("code", "")).alias("at", "did")).where("did NOT IN ('d', '')")
        role = F.when(F.col("did").isin("u", "U"), "user").when(F.col("did").isin("a", "A"), "assistant").otherwise(F.col("role"))
        return one.select("conv", "pos", "at", role.alias("role"), F.when(F.col("did").isin("U", "A"), "").otherwise(F.col("text")).alias("text"))

    def summaries(self) -> DataFrame:
        """DataFrame[conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
        repaired_sha256] of the conversations that have rows."""
        count = lambda fault, n: F.sum(F.when(F.col("fault") == fault, n).otherwise(0)).cast("long").alias(fault)
        again = F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("copies")).otherwise(F.col("copies") - 1)
        turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
        told = self.rows.groupBy("conv").agg(turns.alias("gaps"), count("blank", F.col("copies")), F.sum(again).cast("long").alias("duplicate"), count("truncated", 1))
        digest = _streamed(self.lines().select("conv", "pos", "at", F.concat("role", F.lit(":"), "text").alias("line")), "conv", [F.asc("pos"), F.asc("at")], *_digests(self.kind))
        a, b, c = told.alias("a"), self.paths.where("audit IS NOT NULL").alias("b"), digest.alias("c")
        same = lambda x, y: F.col(f"{x}.conv").eqNullSafe(F.col(f"{y}.conv"))
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        return a.join(b, same("a", "b")).join(c, same("a", "c"), "left").select("a.conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", empty).alias("repaired_sha256"))


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """DataFrame[conv, turn, role, text] with planted faults: CRC-32 of ``conv:turn`` by
    20 leaves 0 (the row goes), 1 (its text goes), 2 (its ``.``, ``!`` and ``?`` go), 3 (it
    comes twice), 4 (its role becomes user)."""
    work, _, (c, t, r, x) = renamed(df, conv, turn, role, text)
    part = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(SPACE))
    rows = work.select(F.col(c).alias("conv"), F.col(t).alias("turn"), F.coalesce(r, F.lit(SPACE)).alias("role"), F.coalesce(x, F.lit(SPACE)).alias("text"), (F.crc32(F.concat(part(c), F.lit(":"), part(t)).cast("binary")) % 20).alias("f"))
    text_ = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("f") == 0, 0).when(F.col("f") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("n")).drop("n")


def damage_and_repair(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The summaries of every conversation of ``df`` after ``damage``; those left
    without rows have zeros."""
    found = Repair(damage(df, conv), conv="conv").summaries()
    # One conversation may have a large share of the rows: counted, not shuffled whole.
    all_ = df.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.count("*").alias("n"))
    joined = all_.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
