"""Repair of damaged conversations: a grammar-compressed minimum-cost edit, shared by all conversations.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. Keep costs 0, Rerole to user or assistant 1, Delete 2, an
inserted empty user or assistant turn 5; blank rows and repeats must be deleted, a truncated row that stays costs 5 more. Per row
only its role's initial and its fault matter, one of nine symbols. What a row can do is a matrix in the (min, +) semiring
over the four states of the pattern (start, after system, after user, after assistant); each entry has the cost and, as a rope, the
least audit of that cost. Re-Pair turns the pairs of symbols that are frequent over all conversations into
rules, and the matrix of each rule is the product of its two parts', made once, bottom-up. A conversation is then the product of the
few matrices that its compressed sequence names.

Audits of equal cost between the same states never are prefixes of one another (one could only go on with inserts, which cost), so the
least audit of a product is the least product of least audits, and products may be taken in any grouping. So a long conversation
is cut into segments of ``SEGMENT`` rows, each multiplied out where it lies; only the matrices of its segments meet, one row each.

``damage`` plants the faults. Order is by conversation and turn (nulls first); rows of the same turn by role, then by the SHA-256 of the text.
Nulls in any column count as one space, except in the output and in ``turn``, where a null has no number. Null conversation
ids are one conversation. Repeated rows are duplicates. Conversations without a row after the damage have zeros, an
empty audit and the hash of an empty text; an empty table gives an empty result. Gaps beyond a long are its largest value. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafspark.llm.storage import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a conversation that are multiplied out together, and the bytes of text after which a segment ends anyway.
SEGMENT, SEGMENT_BYTES = 256, 1 << 22
#: Bounds of the grammar. It only decides how much work is shared: any grammar gives the same repairs.
ROUNDS, RULES = 8, 192
CHUNK_BYTES = 1 << 20
#: Short hashes of possible repeats that are sent to all tasks, at most.
BROADCAST_REPEATS = 100_000

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: Symbol of a row by its role's initial; upper case if truncated, ``x`` for what must go.
_CLASS = {"s": "s", "u": "u", "a": "a"}
_FIRST_RULE = 0x100
_LONGEST = (1 << 63) - 1


# ---- damage and order


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (0 for a dropped row) of damaged rows of a conversation table."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(damaged: DataFrame) -> DataFrame:
    """Rows in order over all partitions, each repeat of an earlier turn's text led by a marker (copies null).

    A conversation may be spread over many partitions, so whether a text was seen earlier is found by its hash, on narrow rows: a short
    hash finds the few that may be repeats, and only these are compared by the long one.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACES))
    ends = F.substring(trimmed, -1, 1)
    hashed = F.unhex(F.sha2("text", 256)).alias("hash")
    rows = damaged.select("*", hashed, (trimmed == "").alias("blank"), (~ends.isin(".", "!", "?")).alias("truncated"))
    known = damaged.where("copies > 0").withColumn("short", F.xxhash64("role", "text"))
    again = stage(known.groupBy("conv_id", "short").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    may = F.col("k.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("k.short") == F.col("c.short"))
    if again.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS:
        repeats = known.alias("k").join(F.broadcast(again).alias("c"), may, "left_semi").where(trimmed != "").select("conv_id", "role", hashed, "turn")
    else:  # no text moves
        thin = known.where(trimmed != "").select("conv_id", "role", hashed, "turn", "short")
        repeats = thin.alias("k").join(again.alias("c"), may, "left_semi").drop("short")
    narrow = stage(repeats)
    first = narrow.groupBy("conv_id", "role", "hash").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("unnumbered")
    )
    first = first.where("least < most OR (unnumbered AND least IS NOT NULL)")
    a, b = narrow.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.expr("a.role = b.role AND a.hash = b.hash")
    later = a.join(b, same).where("a.turn IS NOT NULL AND (b.unnumbered OR a.turn > b.least)")
    markers = later.select("a.conv_id", "a.turn", "a.role", "a.hash")
    both = rows.unionByName(markers, allowMissingColumns=True)
    keys = ["conv_id", "turn", "role", "hash"]
    return both.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("copies").asc_nulls_first())


_SEGMENT_ROW = (
    "part int, seg long, whole boolean, symbols string, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"
)


def _typed(conv_type: T.DataType, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_type), *T.StructType.fromDDL(columns).fields])


class _Segment:
    """Consecutive rows of one conversation while they are read."""

    def __init__(self, conv):
        self.conv, self.symbols, self.roles, self.texts = conv, [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.bytes = 0
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, blank: bool, repeat: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = turn
        symbol = _CLASS.get(initial, "o")
        if blank:
            self.blank += 1
            symbol = "x"
        elif repeat:
            self.duplicate += 1
            symbol = "x"
        elif truncated:
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols.append(symbol)
        # The text of a row that must go is not needed any more.
        self.roles.append(role)
        self.texts.append("" if symbol == "x" else text)
        self.bytes += len(self.texts[-1])

    def row(self, part: int, seg: int, whole: bool) -> dict:
        return {
            "conv_id": self.conv, "part": part, "seg": seg, "whole": whole, "symbols": "".join(self.symbols),
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "first_initial": self.first_initial, "last_initial": self.last_initial, "first_turn": self.first_turn,
            "last_turn": self.last_turn, "turns": self.turns, "roles": self.roles, "texts": self.texts,
        }


def _batched(rows: Iterator[dict], arrow: pa.Schema, limit: int = 2048, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += size(row)
        if len(waiting) >= limit or held > SEGMENT_BYTES:
            yield pa.RecordBatch.from_pylist(waiting, arrow)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, arrow)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def segments(damaged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of conversations cut into segments; ``whole`` marks those that certainly are a whole conversation.

    A conversation at the border of a partition may go on in the next one and is treated as one of several segments.
    """
    ordered = _ordered(damaged).select("conv_id", "turn", "role", "hash", "copies", "text", "blank", "truncated")
    schema = _typed(ordered.schema["conv_id"].dataType, _SEGMENT_ROW)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made() -> Iterator[dict]:
            now, n, first_conv, alone = None, 0, True, True
            last = marked = None
            for conv, turn, role, hashed, copies, text, blank, truncated in _rows(batches):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now.row(part, n, alone and not first_conv)
                        n, first_conv = n + 1, False
                    now, alone, last, marked = _Segment(conv), True, None, None
                key = (turn, role, hashed)
                if copies is None:
                    marked = key
                    continue
                for _ in range(copies):
                    if len(now.symbols) >= segment or now.bytes > SEGMENT_BYTES:
                        yield now.row(part, n, False)
                        n, now, alone = n + 1, _Segment(conv), False
                    now.add(turn, role, text, blank, key in (last, marked), truncated)
                    last = key
            if now is not None:
                yield now.row(part, n, False)

        yield from _batched(made(), _arrow(schema), size=lambda row: sum(map(len, row["texts"])))

    return ordered.mapInArrow(cut, schema)


# ---- matrices


def flat(rope) -> str:
    """The text of a rope: a text, or a pair of ropes."""
    if isinstance(rope, str):
        return rope
    texts, waiting = [], [rope]
    while waiting:
        rope = waiting.pop()
        if isinstance(rope, str):
            texts.append(rope)
        else:
            waiting += (rope[1], rope[0])
    return "".join(texts)


def better(a, b):
    """The cheaper of two entries (cost, rope), the one with the lesser audit if they cost the same; None is no entry."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if flat(a[1]) <= flat(b[1]) else b


def product(left, right):
    """Matrices or vectors as lists of rows of entries: the (min, +) product."""
    out = []
    for row in left:
        ends = []
        for j in STATES:
            best = None
            for entry, there in zip(row, right):
                if entry is not None and there[j] is not None:
                    best = better(best, (entry[0] + there[j][0], (entry[1], there[j][1])))
            ends.append(best)
        out.append(ends)
    return out


def _matrix(entries: dict) -> list:
    return [[entries.get((i, j)) for j in STATES] for i in STATES]


def _emits(kind: str, state: int) -> int | None:
    """State after a turn whose role has this initial, or None where the pattern forbids it."""
    if kind == "s":
        return SYSTEM if state == START else None
    if kind == "u":
        return USER if state != USER else None
    return ASSISTANT if kind == "a" and state == USER else None


def insertions() -> list:
    """Any number of inserted turns; more than two come back to where they were."""
    entries = {(i, i): (0, "") for i in STATES}
    for i in STATES:
        at, n = i, 0
        for _ in range(2):
            at, n = (USER if at != USER else ASSISTANT), n + 1
            entries[i, at] = better(entries.get((i, at)), (INSERT * n, "I" * n))
    return _matrix(entries)


def row_matrix(symbol: str) -> list:
    """What can be done with a row, insertions before it included."""
    entries = {(i, i): (DELETE, "D") for i in STATES}
    if symbol != "x":
        stays = TRUNCATED if symbol.isupper() else 0
        for i in STATES:
            for kind, cost, audit in ((symbol.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                j = _emits(kind, i)
                if j is not None:
                    entries[i, j] = better(entries.get((i, j)), (cost + stays, audit))
    return product(insertions(), _matrix(entries))


class Grammar:
    """Re-Pair rules, oldest first, with one matrix per symbol and rule."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {symbol: row_matrix(symbol) for symbol in "xsuaoSUAO"}
        for i, (left, right) in enumerate(rules):
            made = product(self.matrices[left], self.matrices[right])
            # Flat inside a rule, so that a rope is as deep as a sequence has symbols.
            self.matrices[chr(_FIRST_RULE + i)] = [[e and (e[0], flat(e[1])) for e in row] for row in made]
        self.final = insertions()
        self.known: dict[str, object] = {}

    def compress(self, text: str) -> str:
        for i, (left, right) in enumerate(self.rules):
            text = text.replace(left + right, chr(_FIRST_RULE + i))
        return text

    def transfer(self, symbols: str) -> list:
        """The matrix of a sequence of rows."""
        made = [[(0, "") if i == j else None for j in STATES] for i in STATES]
        for symbol in self.compress(symbols):
            made = product(made, self.matrices[symbol])
        return [[e and (e[0], flat(e[1])) for e in row] for row in made]

    def repair(self, symbols: str) -> tuple[int, str]:
        """(cost, audit) of a whole conversation; sequences that come again are looked up."""
        found = self.known.get(symbols)
        if found is None:
            vector = [[(0, ""), None, None, None]]
            for symbol in self.compress(symbols):
                vector = product(vector, self.matrices[symbol])
            found = self.finish(vector)
            if len(self.known) < 1 << 14:
                self.known[symbols] = found
        return found

    def finish(self, vector) -> tuple[int, str]:
        row = product(vector, self.final)[0]
        cost, rope = better(row[START], row[ASSISTANT])
        return cost, flat(rope)


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> list[tuple[str, str]]:
    """Re-Pair rules of the column ``symbols``: pairs counted by Spark, the most frequent replaced, and again.

    One round takes all frequent pairs that cannot overlap (no symbol is the left one of one pair and the right one of another), so
    rounds are few. What comes to the driver are counts of pairs, at most the square of the number of symbols.
    """
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        grammar_rules = list(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = "\n".join(filter(None, batch.column(0).to_pylist()))
                for i, (left, right) in enumerate(grammar_rules):
                    text = text.replace(left + right, chr(_FIRST_RULE + i))
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                pairs = (codes[:-1] << 32 | codes[1:])[(codes[:-1] != 10) & (codes[1:] != 10)]
                values, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["pair", "n"])

        found = sequences.select("symbols").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        lefts, rights, new = set(), set(), []
        for pair, n in sorted(found.where("n > 1").collect(), key=lambda r: (-r.n, r.pair)):
            left, right = chr(pair >> 32), chr(pair & 0xFFFFFFFF)
            if left in rights or right in lefts or (left == right and left in lefts | rights) or len(rules) + len(new) >= most:
                continue
            lefts.add(left)
            rights.add(right)
            new.append((left, right))
        if not new:
            break
        rules += new
    return rules


# ---- rendering


class _Renderer:
    """Repaired lines of an audit, from any state of the pattern."""

    def __init__(self, state: int = START):
        self.state = state

    def lines(self, audit: str, roles: list[str], texts: list[str]) -> Iterator[str]:
        at = 0
        for edit in audit:
            role = text = None
            if edit == "I":
                text = ""
            else:
                role, text = roles[at], texts[at]
                at += 1
                if edit == "D":
                    continue
            lead = "" if self.state == START else "\n"
            if edit == "K":
                self.state = _emits(role[:1], self.state)
            else:
                role = "user" if self.state != USER else "assistant"
                self.state = _emits(role[0], self.state)
            yield f"{lead}{role}:{text}"


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stats(row: dict) -> dict:
    gaps = 0 if row["first_turn"] is None else row["last_turn"] - row["first_turn"] + 1 - row["turns"]
    return {"gaps": min(gaps, _LONGEST)} | {k: row[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def _finish_whole(cut: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Results of conversations that are one segment."""
    schema = _typed(cut.schema["conv_id"].dataType, _RESULT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)

        def made() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    cost, audit = grammar.repair(row["symbols"])
                    digest = hashlib.sha256()
                    for line in _Renderer().lines(audit, row["roles"], row["texts"]):
                        digest.update(line.encode())
                    done = {"cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}
                    yield {"conv_id": row["conv_id"]} | _stats(row) | done

        yield from _batched(made(), _arrow(schema))

    return cut.where("whole").mapInArrow(finish, schema)


def _transfers(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Narrow rows of segments with their matrices: costs (-1 for none) and audits, row by row."""
    kept = [f for f in parts.schema.fields if f.name not in ("whole", "roles", "texts")]
    schema = T.StructType(kept + T.StructType.fromDDL("costs array<long>, audits array<string>").fields)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)

        def made() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    entries = [e for ends in grammar.transfer(row["symbols"]) for e in ends]
                    yield row | {"costs": [-1 if e is None else e[0] for e in entries], "audits": ["" if e is None else e[1] for e in entries]}

        yield from _batched(made(), _arrow(schema), size=lambda row: 16 * len(row["symbols"]))

    return parts.select([f.name for f in kept]).mapInArrow(multiply, schema)


class _Fold:
    """A conversation's segments multiplied from the left, in order; agreed beginnings of the audits are put aside."""

    def __init__(self, conv):
        self.conv, self.vector, self.agreed, self.cuts = conv, [[(0, ""), None, None, None]], [], []
        self.stats = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.last_initial = None

    def add(self, row: dict) -> None:
        for name in self.stats:
            self.stats[name] += row[name]
        if row["first_initial"] is not None:
            if self.last_initial is not None and self.last_initial + row["first_initial"] not in _LEGAL:
                self.stats["illegal"] += 1
            self.last_initial = row["last_initial"]
        if row["first_turn"] is not None:
            if self.first_turn is None:
                self.first_turn = row["first_turn"]
            if self.last_turn == row["first_turn"]:
                self.stats["turns"] -= 1
            self.last_turn = row["last_turn"]
        entries = [None if c < 0 else (c, a) for c, a in zip(row["costs"], row["audits"])]
        ends = product(self.vector, [entries[4 * i : 4 * i + 4] for i in STATES])[0]
        ends = [e and (e[0], flat(e[1])) for e in ends]
        shared = commonprefix([e[1] for e in ends if e])
        self.agreed.append(shared)
        self.vector = [[e and (e[0], e[1][len(shared) :]) for e in ends]]
        self.cuts.append((row["part"], row["seg"], row["symbols"]))

    def result(self, grammar: Grammar) -> tuple[dict, str]:
        cost, rest = grammar.finish(self.vector)
        audit = "".join(self.agreed) + rest
        row = self.stats | {"first_turn": self.first_turn, "last_turn": self.last_turn}
        return {"conv_id": self.conv, "cost": cost, "audit": audit} | _stats(row), audit

    def pieces(self, audit: str) -> Iterator[dict]:
        """The audit of each segment and the state it starts in; inserts belong to the row they precede, the last ones to the last row."""
        edits = np.frombuffer(audit.encode(), np.uint8)
        rows = np.flatnonzero(edits != ord("I"))
        out = np.concatenate([[0], np.cumsum(edits != ord("D"))])
        first = np.flatnonzero(edits != ord("D"))
        system, at, begin = False, 0, 0
        symbols = (s for _, _, sequence in self.cuts for s in sequence)
        if len(first) and edits[first[0]] == ord("K"):
            row = int(np.searchsorted(rows, first[0]))
            system = next(s for i, s in enumerate(symbols) if i == row) in "sS"
        for k, (part, seg, sequence) in enumerate(self.cuts):
            at += len(sequence)
            end = len(edits) if k == len(self.cuts) - 1 else int(rows[at - 1]) + 1 if at else 0
            n = int(out[begin])
            state = START if n == 0 else SYSTEM if system and n == 1 else USER if (n - system) % 2 else ASSISTANT
            yield {"conv_id": self.conv, "part": part, "seg": seg, "state": state, "piece": audit[begin:end]}
            begin = end


def _finish_cut(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Results of conversations in several segments: matrices meet, audits go back to the texts, hashes run over their lines."""
    conv_type = parts.schema["conv_id"].dataType
    folded_schema = _typed(conv_type, _RESULT + ", part int, seg long, state int, piece string")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)

        def ended(now: _Fold) -> Iterator[dict]:
            result, audit = now.result(grammar)
            yield result
            yield from now.pieces(audit)

        def made() -> Iterator[dict]:
            now = None
            for batch in batches:
                for row in batch.to_pylist():
                    if now is None or now.conv != row["conv_id"]:
                        if now is not None:
                            yield from ended(now)
                        now = _Fold(row["conv_id"])
                    now.add(row)
            if now is not None:
                yield from ended(now)

        yield from _batched(made(), _arrow(folded_schema))

    in_order = _transfers(parts, rules).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    folded = stage(in_order.mapInArrow(fold, folded_schema))
    lines_schema = _typed(conv_type, "part int, seg long, no int, data binary")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    held, size, no = [], 0, 0
                    for line in _Renderer(row["state"]).lines(row["piece"], row["roles"], row["texts"]):
                        held.append(line.encode())
                        size += len(held[-1])
                        if size > CHUNK_BYTES:
                            yield {"conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "no": no, "data": b"".join(held)}
                            held, size, no = [], 0, no + 1
                    if held:
                        yield {"conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "no": no, "data": b"".join(held)}

        yield from _batched(made(), _arrow(lines_schema), limit=256, size=lambda row: len(row["data"]))

    digest_schema = _typed(conv_type, "digest string")

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            conv, digest = None, None
            for this, data in _rows(batches):
                if digest is None or this != conv:
                    if digest is not None:
                        yield {"conv_id": conv, "digest": digest.hexdigest()}
                    conv, digest = this, hashlib.sha256()
                digest.update(data)
            if digest is not None:
                yield {"conv_id": conv, "digest": digest.hexdigest()}

        yield from _batched(made(), _arrow(digest_schema))

    pieces = folded.where("piece IS NOT NULL").select("conv_id", "part", "seg", "state", "piece")
    texts = parts.select("part", "seg", "roles", "texts")
    lines = pieces.join(texts, ["part", "seg"]).mapInArrow(render, lines_schema)
    sums = (
        lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", "no").select("conv_id", "data").mapInArrow(hash_lines, digest_schema)
    )
    results = folded.where("piece IS NULL").drop("part", "seg", "state", "piece").alias("r")
    found = results.join(sums.alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    names = [c.split(" ")[0] for c in _RESULT.split(", ") if not c.startswith("repaired")]
    return found.select("r.conv_id", *[f"r.{n}" for n in names], F.coalesce("s.digest", F.lit(empty)).alias("repaired_sha256"))


def repair_conversations(damaged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, copies): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    cut = stage(segments(damaged, segment))
    rules = learn_grammar(cut)
    return _finish_whole(cut, rules).unionByName(_finish_cut(cut.where("NOT whole"), rules))
