"""Repairs the turn structure of conversations: a min-plus matrix scan.

A conversation is to read `(s?(ua)+)?` in its roles' initials.  Each turn is a
4x4 matrix over the states of that pattern (start, s, u, a); an element is the
cheapest (cost, audit) from one state to another, and the closure of insertions
stands in front of the turn.  Products take the cheaper element, of equal costs
the audit that is least in ASCII.  Both paths of an element read the same turns,
so an audit is never a beginning of another of its cost, and the product is
associative: a conversation is reduced as a tree, within partitions first.

Rows are spread by ranges of (conversation, turn, role, text), so one
conversation may fill many partitions.  Those that lie inside a partition are
repaired on the spot.  Of those that reach its ends, each partition gives the
product of its part; parts are multiplied up a tree of FAN branches, and the
states that the cheapest path passes come down the same tree, so each part
knows its own stretch of the audit.  Texts are shuffled once, and once more
for conversations that reach a partition's end.  Repeated turns are found by
SHA-256 of their texts, in shuffles of digests.

Defined results: null roles and texts are one space; rows are ordered by turn
(null first), then role and text's digest, so copies are neighbours; a first
fault counts: blank, duplicate (role and text stood earlier), truncated (no
`.!?` at the end).  Conversations without conv_id are one conversation.
Conversations of `ids` that have no rows get zeros and empty strings.  Other
columns are not read, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import stored

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults of a row; what has to go is one code, whatever its role.
SOUND, CUT, GONE = range(3)
LEGAL = frozenset({"su", "ua", "au"})
#: Parts that are multiplied at once.
FAN = 32
#: Characters of a conversation that a task holds while it waits for its end.
HELD = 16 << 20
_SPACE = " \t\n\v\f\r"

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: costs add, audits follow one another."""

    def element(p: int, q: int) -> Element:
        best = None
        for m in STATES:
            x, y = a[p][m], b[m][q]
            if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                new = (x[0] + y[0], x[1] + y[1])
                best = new if best is None else min(best, new)
        return best

    return tuple(tuple(element(p, q) for q in STATES) for p in STATES)


def _matrix(steps: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(steps.get((p, q)) for q in STATES) for p in STATES)


#: Any number of insertions: a state reaches u in one or two, and a likewise.
INSERTS = _matrix(
    {(p, p): (0, "") for p in STATES}
    | {(START, USER): (INSERT, "I"), (SYSTEM, USER): (INSERT, "I"), (ASSISTANT, USER): (INSERT, "I"), (USER, ASSISTANT): (INSERT, "I")}
    | {(START, ASSISTANT): (2 * INSERT, "II"), (SYSTEM, ASSISTANT): (2 * INSERT, "II")}
)


def _after(state: int, initial: str) -> int | None:
    """The state behind a turn of this initial."""
    return {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}.get((initial, state))


def code(initial: str, fault: int) -> str:
    """A turn as one letter: upper case where it is truncated, X where it has to go."""
    own = initial if initial in ("s", "u", "a") else "o"
    return "X" if fault == GONE else own.upper() if fault == CUT else own


@lru_cache(maxsize=None)
def turn_matrix(letter: str) -> Matrix:
    """Of one turn, with insertions in front."""
    steps: dict[tuple[int, int], Element] = {(p, p): (DELETE, "D") for p in STATES}
    if letter != "X":
        extra = TRUNCATED if letter.isupper() else 0
        for p in STATES:
            if (q := _after(p, letter.lower())) is not None:
                steps[p, q] = (KEEP + extra, "K")
            wanted = ASSISTANT if p == USER else USER
            steps[p, wanted] = min(steps.get((p, wanted), (REROLE + extra, "R")), (REROLE + extra, "R"))
    return times(INSERTS, _matrix(steps))


@lru_cache(maxsize=1 << 14)
def _short(codes: str) -> Matrix:
    return turn_matrix(codes) if len(codes) == 1 else times(_short(codes[: len(codes) // 2]), _short(codes[len(codes) // 2 :]))


def product(codes: str) -> Matrix:
    """Of consecutive turns, as a tree."""
    if len(codes) <= 4:
        return _short(codes)
    half = 4
    while 2 * half < len(codes):
        half *= 2
    return times(product(codes[:half]), product(codes[half:]))


def ending(whole: Matrix) -> tuple[int, int, str]:
    """(state, cost, audit) of the cheapest path through all turns; `whole` ends with INSERTS."""
    cost, audit, state = min((*whole[START][q], q) for q in (START, ASSISTANT) if whole[START][q] is not None)
    return state, cost, audit


def replayed(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit of `audit` over (role, text) rows; deleted rows have neither."""
    rows = iter(rows)
    for edit in audit:
        wanted, after = ("assistant", ASSISTANT) if state == USER else ("user", USER)
        if edit == "I":
            state = after
            yield edit, wanted, ""
            continue
        role, text = next(rows)
        if edit == "D":
            yield edit, None, None
            continue
        if edit == "K":
            wanted, after = role, _after(state, role[:1])
        state = after
        yield edit, wanted, text


class _Digest:
    """SHA-256 of `role:text` lines, turn by turn."""

    def __init__(self) -> None:
        self.hash, self.first = hashlib.sha256(), True

    def add(self, turns: Iterable[tuple[str, str | None, str | None]]) -> _Digest:
        for _, role, text in turns:
            if role is not None:
                self.hash.update((f"{role}:{text}" if self.first else f"\n{role}:{text}").encode())
                self.first = False
        return self


def fault_of(text: str, repeated: bool) -> tuple[int, int]:
    """(what the code says, which of blank 0, duplicate 1, truncated 2 it is or -1)."""
    said = text.rstrip(_SPACE)
    if not said:
        return GONE, 0
    if repeated:
        return GONE, 1
    return (SOUND, -1) if said[-1] in ".!?" else (CUT, 2)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_ELEMENTS = "array<struct<cost:long,audit:string>>"
_PART = f"conv string, part long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, first string, last string, matrix {_ELEMENTS}"
_OUT = f"kind string, pos long, role string, text string, code string, copies long, cost long, audit string, repaired_sha256 string, {_PART}"


def _flat(m: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "audit": e[1]} for row in m for e in row]


def _matrix_of(flat: list[dict | None]) -> Matrix:
    e = [None if x is None else (x["cost"], x["audit"]) for x in flat]
    return tuple(tuple(e[4 * p : 4 * p + 4]) for p in STATES)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), _ELEMENTS: pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


class _Part:
    """The turns of a conversation in one partition, in order."""

    def __init__(self, conv: str, part: int) -> None:
        self.conv, self.part, self.codes, self.counts = conv, part, [], [0, 0, 0, 0]
        self.first = self.last = None
        self.rows: list[dict] = []
        self.held, self.pos = 0, 0

    def add(self, role: str, text: str, n: int, repeated: bool) -> dict:
        """A turn and its further copies."""
        fault, which = fault_of(text, repeated)
        initial, more = role[:1], n - 1
        if which >= 0:
            self.counts[which] += 1
        self.counts[0 if which == 0 else 1] += more
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.counts[3] += 1
        self.counts[3] += more  # copies have the role of their neighbour, which is never legal
        self.last = initial
        self.codes.append(code(initial, fault) + "X" * more)
        row = {"kind": "row", "conv": self.conv, "part": self.part, "pos": self.pos, "role": role, "text": text, "copies": n}
        self.pos += 1
        return row

    def summary(self, kind: str) -> dict:
        names = ("n_blank", "n_duplicate", "n_truncated", "n_illegal")
        return {"kind": kind, "conv": self.conv, "part": self.part, **dict(zip(names, self.counts, strict=True))}

    def part_row(self) -> dict:
        return self.summary("part") | {"first": self.first, "last": self.last, "matrix": _flat(product("".join(self.codes)))}

    def whole_row(self) -> dict:
        _, cost, audit = ending(times(product("".join(self.codes)), INSERTS))
        copies = ((r["role"], r["text"]) for r in self.rows for _ in range(r["copies"]))
        return self.summary("whole") | {"cost": cost, "audit": audit, "repaired_sha256": _Digest().add(replayed(copies, audit)).hash.hexdigest()}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition: conversations inside it as `whole`, those at its ends as `row`s and one `part`."""
    schema, out, size = _arrow(_OUT), [], 0
    now: _Part | None = None
    at_end = True
    previous = marked = None

    def put(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        nonlocal out, size
        out += rows
        size += sum(len(r.get("text") or "") + 200 for r in rows)
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0

    for batch in batches:
        for conv, turn, role, digest, mark, text, n in zip(*(batch.column(k).to_pylist() for k in ("conv", "turn", "role", "digest", "mark", "text", "n")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from put([now.part_row()] if at_end else [now.whole_row()])
                at_end = now is None  # the first conversation may have begun in the partition before
                now = _Part(conv, TaskContext.get().partitionId())
            key = (conv, turn, role, digest)
            if mark:
                marked = key
                continue
            row = now.add(role, text, n, key in (previous, marked))
            previous = key
            if not at_end:
                now.rows.append(row)
                now.held += len(text)
                if now.held > HELD:
                    rows, now.rows, at_end = now.rows, [], True
                    yield from put(rows)
            else:
                yield from put([row])
    if now is not None:
        yield from put([*now.rows, now.part_row()])
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _copies_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with their number."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["conv", "turn", "role", "digest", "mark", "text"], use_threads=False).aggregate([([], "count_all")])
        yield from t.rename_columns([*t.column_names[:-1], "n"]).combine_chunks().to_batches()


def _joined(parts: list[dict]) -> dict:
    """Consecutive parts of one conversation as one."""
    parts = sorted(parts, key=lambda p: p["part"])
    out = dict(parts[0])
    for p in parts[1:]:
        for c in ("n_blank", "n_duplicate", "n_truncated"):
            out[c] += p[c]
        out["n_illegal"] += p["n_illegal"] + (out["last"] + p["first"] not in LEGAL)
        out["last"] = p["last"]
    matrices = [_matrix_of(p["matrix"]) for p in parts]
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[2 * len(pairs) :]
    return out | {"part": parts[0]["part"] // FAN, "matrix": _flat(matrices[0])}


def _up(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([_joined(table.to_pylist())], _arrow(_PART))


_DOWN = "conv string, part long, begin int, end int"


def _down(table: pa.Table) -> pa.Table:
    """The states at which the cheapest path from `begin` to `end` enters and leaves each part."""
    parts = sorted(table.to_pylist(), key=lambda p: p["part"])
    paths = {parts[0]["begin"]: (0, "", ())}
    for p in parts:
        m, nxt = _matrix_of(p["matrix"]), {}
        for s, (cost, audit, states) in paths.items():
            for q in STATES:
                if m[s][q] is not None:
                    new = (cost + m[s][q][0], audit + m[s][q][1], (*states, q))
                    nxt[q] = min(nxt.get(q, new), new)
        paths = nxt
    ends = paths[parts[0]["end"]][2]
    begins = (parts[0]["begin"], *ends)
    return pa.Table.from_pylist([{"conv": p["conv"], "part": p["part"], "begin": b, "end": e} for p, b, e in zip(parts, begins, ends, strict=False)], _arrow(_DOWN))


_DONE = "conv string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, cost long, audit string, end int, total string"


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tops of the trees: cost and audit, the state before the last insertions, and those."""
    for b in batches:
        rows = []
        for p in b.to_pylist():
            top = _matrix_of(p["matrix"])
            _, cost, audit = ending(times(top, INSERTS))
            ways = [(top[START][m][0] + x[0], top[START][m][1] + x[1], m, x[1]) for m in STATES for q in (START, ASSISTANT) if top[START][m] and (x := INSERTS[m][q])]
            _, _, end, tail = min(ways)
            rows.append({k: p[k] for k in ("conv", "n_blank", "n_duplicate", "n_truncated", "n_illegal")} | {"cost": cost, "audit": audit, "end": end, "total": tail})
        yield pa.RecordBatch.from_pylist(rows, _arrow(_DONE))


def _streamed(rows_out: bool):
    """Rows and, in front of each part, its state and audit: repaired turns, or a digest for each conversation, with constant memory."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_TURNS if rows_out else _SHA)
        conv, digest, audit, at, state, out = None, None, "", 0, START, []

        def take(turn: tuple[str, str] | None) -> list[tuple[str, str | None, str | None]]:
            """Edits up to and with the one that reads the turn; without a turn, insertions that are left."""
            nonlocal at, state
            stop = at
            while stop < len(audit) and audit[stop] == "I":
                stop += 1
            stop += turn is not None
            done = list(replayed([turn] if turn else [], audit[at:stop], state))
            for _, role, _ in done:
                state = state if role is None else _after(state, role[:1])
            at = stop
            return done

        def emit(done: list, part: int, pos: int) -> None:
            if rows_out:
                out.extend({"conv": conv, "part": part, "pos": pos, "edit": e, "role": r, "text": t} for e, r, t in done)
            else:
                digest.add(done)

        for b in batches:
            for r in b.to_pylist():
                if r["conv"] != conv:
                    if conv is not None and not rows_out:
                        out.append({"conv": conv, "repaired_sha256": digest.hash.hexdigest()})
                    conv, digest = r["conv"], _Digest()
                if r["kind"] == "part":
                    audit, at, state = r["audit"], 0, r["begin"]
                    if not r["n_rows"]:
                        emit(take(None), r["part"], 0)
                    continue
                for _ in range(r["copies"]):
                    emit(take((r["role"], r["text"])), r["part"], r["pos"])
            if rows_out and out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if conv is not None and not rows_out:
            out.append({"conv": conv, "repaired_sha256": digest.hash.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return stream


_SHA = "conv string, repaired_sha256 string"
_TURNS = "conv string, part long, pos long, edit string, role string, text string"
#: Sorts behind all parts: the insertions after the last turn.
_LAST = 1 << 62


def _key(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select(_conv(F.col("conv_id")), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def _conv(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit("")).alias("conv")


def _id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id")


def _states(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(top of each conversation, (conv, part, begin, end) of each part)."""
    levels = [parts]
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        levels.append(stored(levels[-1].groupBy("conv", F.expr(f"part div {FAN}").alias("above")).applyInArrow(_up, _PART), "parts"))
        most //= FAN
        if not most:
            break
    tops = stored(levels[-1].mapInArrow(_ended, _DONE), "tops")
    ways = tops.select("conv", F.lit(0).cast("long").alias("part"), F.lit(START).alias("begin"), "end")
    for level in reversed(levels[:-1]):
        known = ways.select("conv", F.col("part").alias("above"), "begin", "end")
        below = level.withColumn("above", F.expr(f"part div {FAN}")).join(known, ["conv", "above"])
        ways = stored(below.groupBy("conv", "above").applyInArrow(_down, _DOWN), "ways")
    return tops, ways


class Repair:
    """The repair of `turns` (conv_id, turn, role, text); `ids` (conv_id) names conversations that get a row in any case."""

    def __init__(self, turns: DataFrame, ids: DataFrame | None = None) -> None:
        rows = _key(turns)
        self.counted = stored(rows.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n")), "turns")
        self.ids = (turns if ids is None else ids).select(_conv(F.col("conv_id"))).distinct()
        mark = F.lit(False).alias("mark")
        later = self._later().select("conv", "turn", "role", "digest", F.lit(True).alias("mark"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"))
        once = rows.select("conv", "turn", "role", "digest", mark, "text").mapInArrow(_copies_counted, "conv string, turn long, role string, digest binary, mark boolean, text string, n long")
        # A mark stands before the rows it is about, and in their partition, as the keys are the same.
        order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
        ordered = once.unionByName(later).repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc())
        self.scanned = stored(ordered.mapInArrow(_scanned, _OUT), "repair")
        self.parts = self.scanned.filter("kind = 'part'").select(*[c.split()[0] for c in _PART.split(", ")])
        self.tops, self.ways = _states(self.parts)

    def _later(self) -> DataFrame:
        """Turns at which a role and text stand that stood at an earlier one."""
        first = F.min(F.struct(F.col("turn").isNotNull().alias("is"), "turn")).alias("first")
        many = self.counted.groupBy("conv", "role", "digest").agg(first, F.count("*").alias("n_turns")).filter("n_turns > 1").select("conv", "role", "digest", "first.turn")
        many = many.withColumnRenamed("turn", "first_turn")
        return self.counted.join(many, ["conv", "role", "digest"]).filter(~F.col("turn").eqNullSafe(F.col("first_turn")))

    def _edges(self) -> DataFrame:
        """Rows of conversations at the ends of partitions, in front of each part its way, behind all the last insertions."""
        entry = F.element_at("matrix", F.col("begin") * 4 + F.col("end") + 1).getField("audit")
        ways = self.parts.join(self.ways, ["conv", "part"]).select("conv", "part", F.lit(-1).cast("long").alias("pos"), F.lit("part").alias("kind"), entry.alias("audit"), "begin", F.lit(1).alias("n_rows"))
        last = self.tops.select("conv", F.lit(_LAST).alias("part"), F.lit(-1).cast("long").alias("pos"), F.lit("part").alias("kind"), F.col("total").alias("audit"), F.col("end").alias("begin"), F.lit(0).alias("n_rows"))
        rows = self.scanned.filter("kind = 'row'").select("conv", "part", "pos", "kind", "role", "text", "copies")
        return rows.unionByName(ways.unionByName(last), allowMissingColumns=True)

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256) of conversations at the ends of partitions.  A SHA-256 is serial by its definition: a conversation's texts pass one task, as a stream."""
        return self._edges().repartition("conv").sortWithinPartitions("conv", "part", "pos").mapInArrow(_streamed(False), _SHA)

    def turns(self) -> DataFrame:
        """conv_id, part, pos, edit, role, text: every edit of the conversations at the ends of partitions, in the order of part and pos; deleted turns have neither role nor text."""
        told = self._edges().repartition("conv", "part").sortWithinPartitions("conv", "part", "pos").mapInArrow(_streamed(True), _TURNS)
        return told.select(_id(), "part", "pos", "edit", "role", "text")

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
        counts = [F.col(f"n_{c}").alias(c) for c in _COUNTS]
        whole = self.scanned.filter("kind = 'whole'").select("conv", *counts, "cost", "audit", "repaired_sha256")
        edges = self.tops.select("conv", *counts, "cost", "audit").join(self.digests(), "conv")
        gaps = self.counted.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
        none = hashlib.sha256(b"").hexdigest()
        found = self.ids.join(whole.unionByName(edges).join(gaps, "conv"), "conv", "left")
        zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
        return found.select(_id(), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
