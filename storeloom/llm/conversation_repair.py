"""Conversations brought into the order ``(s?(ua)+)?`` by their cheapest edits.

Ordinary conversations are repaired many at a time in the task that holds their turns.
One with very many turns is cut into pieces along its order: each piece is summed up by the
costs of getting through it and by how it ranks the states before it, the sums are strung
together, one row per piece, and then every piece is edited by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.functions.hot import hot_keys, mark_hot
from storeloom.llm.common import saved
from storeloom.llm.path_ranking import (
    ASSISTANT,
    D,
    E,
    END,
    I,
    K,
    LETTERS,
    START,
    STATES,
    USER,
    Kind,
    Ranked,
    before,
    costs_through,
    kind_of,
)

# Fixed value: the white space that alone makes a turn blank.
SPACES = "\t\n\x0b\x0c\r "
# Turns of a conversation beyond which it is cut into pieces of about that many.
PIECE_TURNS = 50_000
# Turns that a task solves at once.
BATCH_TURNS = 20_000
ROLES = {USER: "user", ASSISTANT: "assistant"}
ORDERLY = {"su", "ua", "au"}

_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
_REPORT = f"_conv {{kind}}, {_COUNTS}, cost long, audit string, repaired_sha256 string"
_TURNS = "_roles array<string>, _texts array<string>"


class _Faults:
    """Kinds and counts of the turns of one conversation, or of a piece of one, in order."""

    def __init__(self) -> None:
        self.kinds: list[Kind] = []
        self.turns: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.numbers: set[int] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def add(self, number: int | None, role: str, text: str, repeated: bool | None = None) -> None:
        """``repeated`` says whether role and text came before; None: look among those added."""
        own = (role, text)
        if repeated is None:
            repeated = own in self.seen
            self.seen.add(own)
        if number is not None:
            self.numbers.add(number)
        ending = text.rstrip(SPACES)
        blank = not ending
        repeated = repeated and not blank
        cut_off = not blank and not repeated and ending[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut_off
        initial = role[:1]
        if self.last is not None and self.last + initial not in ORDERLY:
            self.illegal += 1
        self.last = initial
        self.kinds.append(kind_of(initial, blank or repeated, cut_off))
        self.turns.append(own)

    @property
    def gaps(self) -> int:
        return max(self.numbers) - min(self.numbers) + 1 - len(self.numbers) if self.numbers else 0


def _edited(
    turns: list[tuple[str, str]], path: list[tuple[int, int, int]]
) -> tuple[str, list[str], list[str]]:
    """The audit, and the roles and texts that are left."""
    audit, roles, texts = [], [], []
    for edit, at, state in path:
        if edit == E:
            continue
        audit.append(LETTERS[edit])
        if edit != D:
            role, text = ("", "") if edit == I else turns[at]
            roles.append(role if edit == K else ROLES[state])
            texts.append(text)
    return "".join(audit), roles, texts


def _lines(roles: list[str], texts: list[str]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))


def _report(kind: pa.DataType, rows: list[tuple[object, _Faults]]) -> pa.RecordBatch:
    """Whole conversations, solved together."""
    zero = (0,) * STATES
    solved = Ranked([[*f.kinds, END] for _, f in rows], [zero] * len(rows), [zero] * len(rows))
    out = []
    for (conv, f), path, cost in zip(rows, solved.paths([START] * len(rows)), solved.cost):
        audit, roles, texts = _edited(f.turns, path)
        digest = sha256(_lines(roles, texts).encode()).hexdigest()
        counts = (f.gaps, f.blank, f.duplicate, f.truncated, f.illegal)
        out.append((conv, *counts, cost[START], audit, digest, roles, texts))
    columns = list(zip(*out))
    string, number = pa.string(), pa.int64()
    kinds = [kind, *[number] * 6, string, string, pa.list_(string), pa.list_(string)]
    names = ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=[*names, "repaired_sha256", "_roles", "_texts"],
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and order to one row per conversation."""
    rows: list[tuple[object, _Faults]] = []
    held = 0
    for batch in batches:
        kind = batch.schema.field("_conv").type
        columns = (batch.column(n).to_pylist() for n in ("_conv", "_kept", "_turn", "_role", "_body"))
        for conv, kept, number, role, text in zip(*columns):
            if not rows or rows[-1][0] != conv:
                if held >= BATCH_TURNS:
                    yield _report(kind, rows)
                    rows, held = [], 0
                rows.append((conv, _Faults()))
            held += 1
            if kept:
                rows[-1][1].add(number, role, text)
    if rows:
        yield _report(kind, rows)


def _piece(pdf: pd.DataFrame) -> _Faults:
    faults = _Faults()
    ordered = pdf.sort_values("_place")
    for role, text, repeated in zip(ordered["_role"], ordered["_body"], ordered["_repeated"]):
        faults.add(None, role, text, repeated)
    if pdf["_ends"].iloc[0]:
        faults.kinds.append(END)
    return faults


def _through(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """What a piece counts and costs, from every state before it to every state after it."""
    f = _piece(pdf)
    flat = [c for row in costs_through(f.kinds) for c in row]
    first = f.turns[0][0][:1]
    counts = [f.blank, f.duplicate, f.truncated, f.illegal]
    return pd.DataFrame([[*key, *counts, first, f.last, flat]])


def _costs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs after each piece of one conversation, and its counts; a row per piece."""
    rows = pdf.sort_values("_part").to_dict("records")
    after, out = [0] * STATES, []
    for r in reversed(rows):
        out.append([*key, r["_part"], [int(a) for a in after]])
        flat = [int(c) for c in r["_through"]]
        after = before([flat[q * STATES : (q + 1) * STATES] for q in range(STATES)], after)
    seams = sum(a["_last"] + b["_first"] not in ORDERLY for a, b in zip(rows, rows[1:]))
    sums = [sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")]
    sums[3] += seams
    return pd.DataFrame([[*row, *sums, after[START]] for row in out])


def _orders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """How a piece ranks the states before it, and where its least audits may end."""
    solved = Ranked([_piece(pdf).kinds], [tuple(map(int, pdf["_after"].iloc[0]))], [(0,) * STATES])
    rank, reach = solved.starts()
    return pd.DataFrame([[*key, rank[0].tolist(), reach[0].tolist()]])


def _states(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before and after each piece on the least path; a row per piece."""
    rows = pdf.sort_values("_part").to_dict("records")
    order, leads = [0] * STATES, []
    for r in reversed(rows):
        best = [
            min((order[t], t) for t in range(STATES) if int(reach) >> t & 1) for reach in r["_reach"]
        ]
        leads.append([t for _, t in best])
        keys = [(int(rank), b[0]) for rank, b in zip(r["_rank"], best)]
        order = [sum(other < own for other in keys) for own in keys]
    state, out = START, []
    for r, lead in zip(rows, reversed(leads)):
        out.append([*key, r["_part"], state, lead[state]])
        state = lead[state]
    return pd.DataFrame(out)


def _edit_piece(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The audit, roles and texts of a piece whose states before and after it are known."""
    f, head = _piece(pdf), pdf.iloc[0]
    order = tuple(0 if q == head["_out"] else 1 for q in range(STATES))
    solved = Ranked([f.kinds], [tuple(map(int, head["_after"]))], [order])
    return pd.DataFrame([[*key, *_edited(f.turns, solved.paths([int(head["_in"])])[0])]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place to a digest each; holds one batch of pieces."""
    key, state, begun = None, None, False

    def done() -> pa.RecordBatch:
        digest = pa.array([state.hexdigest()])
        return pa.RecordBatch.from_arrays([key, digest], names=["_conv", "repaired_sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column("_conv").slice(i, 1)
            if state is None or not own.equals(key):
                if state is not None:
                    yield done()
                key, state, begun = own, sha256(), False
            roles, texts = (batch.column(n)[i].as_py() for n in ("_roles", "_texts"))
            if roles:
                state.update((b"\n" if begun else b"") + _lines(roles, texts).encode())
                begun = True
    if state is not None:
        yield done()


@dataclass(frozen=True)
class Repaired:
    """``report``: a row per conversation; ``turns``: what is left of it, in order.

    ``report`` has the id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit`` and ``repaired_sha256``; ``turns`` has the id, ``part`` and ``place``
    in it, role and text.
    """

    report: DataFrame
    turns: DataFrame


def _big(rows: DataFrame, kind: str, piece_turns: int) -> tuple[DataFrame, DataFrame]:
    """Report and pieces of conversations that are cut into pieces."""
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_body"), F.col("_copy")]
    kept = rows.filter("_kept").withColumn("_copy", F.monotonically_increasing_id())
    parts = max(1, -(-kept.count() // piece_turns))
    # Ranges of the whole order, ties and copies included, so a single turn number, role or
    # text is split as well; places grow along all of them.
    ranged = saved(
        kept.repartitionByRange(parts, F.col("_conv"), *order)
        .sortWithinPartitions("_conv", *order)
        .select(
            "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")
        )
        .drop("_copy"),
        "repair-pieces",
    )
    named = ranged.withColumn("_name", F.unhex(F.md5(F.concat("_role", F.lit(":"), "_body"))))
    first = named.groupBy("_conv", "_role", "_name").agg(F.min("_place").alias("_first"))
    last = ranged.groupBy("_conv").agg(F.max("_part").alias("_end"))
    same = ["_conv", "_role", "_name"]
    turns = saved(
        _joined(_joined(named, first, same), last, ["_conv"])
        .withColumn("_repeated", F.col("_place") > F.col("_first"))
        .withColumn("_ends", F.col("_part") == F.col("_end"))
        .drop("_first", "_name", "_kept", "_end"),
        "repair-turns",
    )
    by_piece = ["_conv", "_part"]
    counts = "blank long, duplicate long, truncated long, illegal long"
    through = turns.groupBy(*by_piece).applyInPandas(
        _through,
        f"_conv {kind}, _part int, {counts}, _first string, _last string, _through array<long>",
    )
    costs = saved(
        saved(through, "repair-through")
        .groupBy("_conv")
        .applyInPandas(_costs, f"_conv {kind}, _part int, _after array<long>, {counts}, cost long"),
        "repair-costs",
    )
    priced = _joined(turns, costs.select(*by_piece, "_after"), by_piece)
    orders = priced.groupBy(*by_piece).applyInPandas(
        _orders, f"_conv {kind}, _part int, _rank array<long>, _reach array<int>"
    )
    states = saved(
        saved(orders, "repair-orders")
        .groupBy("_conv")
        .applyInPandas(_states, f"_conv {kind}, _part int, _in int, _out int"),
        "repair-states",
    )
    pieces = saved(
        _joined(priced, states, by_piece)
        .groupBy(*by_piece)
        .applyInPandas(_edit_piece, f"_conv {kind}, _part int, audit string, {_TURNS}"),
        "repair-edited",
    )
    audits = pieces.groupBy("_conv").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_part", "audit"))), lambda p: p["audit"]), ""
        ).alias("audit")
    )
    digests = (
        pieces.repartition("_conv")
        .sortWithinPartitions("_conv", "_part")
        .mapInArrow(_digests, f"_conv {kind}, repaired_sha256 string")
    )
    gaps = rows.filter("_kept").select("_conv", "_turn").distinct().groupBy("_conv").agg(
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).alias("gaps")
    )
    sums = costs.drop("_part", "_after").distinct()
    whole = _joined(_joined(_joined(sums, audits, ["_conv"]), digests, ["_conv"]), gaps, ["_conv"])
    # Those of whom nothing is left after the damage have no piece.
    zero = F.lit(0).cast("long")
    report = _joined(rows.select("_conv").distinct(), whole, ["_conv"], "left").select(
        "_conv",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return report, pieces.select("_conv", "_part", "_roles", "_texts")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null."""
    other = right.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_r{k}" for k in keys])


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    kept: Column | None = None,
    piece_turns: int = PIECE_TURNS,
) -> Repaired:
    """Every conversation with the cheapest edits that give its role initials ``(s?(ua)+)?``.

    A turn is kept (0), given the role user or assistant (3) or deleted (4); a user or
    assistant turn without text can be put in anywhere (3).  Blank turns and those whose role
    and text came before must go; one that does not end with ``.``, ``!`` or ``?`` costs 3 more
    unless it is deleted.  Of equally cheap edits the ASCII-least audit counts.

    Turns are taken by number, those without one first, then by role and text.  A null role
    or text is one space; a null conversation is one like others.  Rows that are not ``kept``
    only make their conversation appear; one without turns has zeros and an empty audit.
    Very long texts are never cut.  Other columns, whatever their names, are not looked at.

    A sample finds the conversations with more than about ``piece_turns`` turns; all others
    are repaired whole, in tasks that hold one batch of them.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("_conv"),
        F.coalesce(F.lit(True) if kept is None else kept, F.lit(False)).alias("_kept"),
        F.col(f"`{turn_col}`").cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`"), space).alias("_role"),
        F.coalesce(F.col(f"`{text_col}`"), space).alias("_body"),
    )
    kind = rows.schema["_conv"].dataType.simpleString()
    hot = hot_keys(rows, ["_conv"], piece_turns)
    small = rows
    if hot is not None:
        marked = mark_hot(rows, hot)
        small, large = marked.filter("NOT _hot").drop("_hot"), marked.filter("_hot").drop("_hot")
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_body")]
    report = saved(
        small.repartition("_conv")
        .sortWithinPartitions("_conv", *order)
        .mapInArrow(_whole, f"{_REPORT.format(kind=kind)}, {_TURNS}"),
        "repair-whole",
    )
    left = report.select("_conv", F.lit(0).alias("_part"), "_roles", "_texts")
    report = report.drop("_roles", "_texts")
    if hot is not None:
        big_report, big_left = _big(large, kind, piece_turns)
        report, left = report.unionByName(big_report), left.unionByName(big_left)
    placed = F.posexplode(F.arrays_zip("_roles", "_texts")).alias("place", "_own")
    return Repaired(
        report.withColumnRenamed("_conv", conv_col),
        left.select("_conv", "_part", placed).select(
            F.col("_conv").alias(conv_col),
            F.col("_part").alias("part"),
            "place",
            F.col("_own._roles").alias(role_col),
            F.col("_own._texts").alias(text_col),
        ),
    )
