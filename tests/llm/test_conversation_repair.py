import itertools
import random
import re
from binascii import crc32

import pytest
from llm.odd import sha, stored
from pyspark.sql import functions as F

from storeloom.llm.conversation_repair import repair
from storeloom.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")
BLANK = "\t\n\x0b\x0c\r "


def damage(rows):
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        ending = text.rstrip(BLANK)
        blank = not ending
        again = not blank and (role, text) in seen
        seen.add((role, text))
        out.append("b" if blank else "d" if again else "t" if ending[-1] not in ".!?" else "")
    return out


def moves(turn, fault):
    """(letter, cost, what is left) for a turn that is used up."""
    yield "D", 4, None
    if fault not in ("b", "d"):
        more = 3 * (fault == "t")
        yield "K", more, turn
        yield "R", 3 + more, ("user", turn[1])
        yield "R", 3 + more, ("assistant", turn[1])


def exhaustive(turns):
    """All edits with up to two insertions in each gap."""
    gaps = [g for n in range(3) for g in itertools.product(["user", "assistant"], repeat=n)]
    best = None
    for choice in itertools.product(*[list(moves(t, f)) for t, f in zip(turns, faults(turns))]):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            cost, audit, left = 0, "", []
            for i, g in enumerate(put):
                cost, audit = cost + 3 * len(g), audit + "I" * len(g)
                left += [(r, "") for r in g]
                if i < len(turns):
                    letter, c, kept = choice[i]
                    cost, audit = cost + c, audit + letter
                    left += [kept] if kept else []
            if PATTERN.fullmatch("".join(r[:1] for r, _ in left)):
                best = min(best or (9**9,), (cost, audit, left))
    return best


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(turns):
    """One conversation, whole audits compared; a state is the last role kept."""
    states = ["", "s", "u", "a"]
    best = {q: (0, "", ()) for q in ("", "a")}
    marks = faults(turns)
    for i in range(len(turns), -1, -1):
        here = dict(best) if i == len(turns) else {}
        if i < len(turns):
            for q in states:
                for letter, cost, kept in moves(turns[i], marks[i]):
                    to = q if kept is None or not kept[0][:1] else STEP.get((q, kept[0][:1]))
                    if to in best:
                        rest = best[to]
                        more = () if kept is None else (kept,)
                        one = (cost + rest[0], letter + rest[1], more + rest[2])
                        here[q] = min(here.get(q, one), one)
        for _ in states:
            for q in states:
                for role in ("user", "assistant"):
                    to = STEP.get((q, role[0]))
                    if to in here:
                        one = (3 + here[to][0], "I" + here[to][1], ((role, ""),) + here[to][2])
                        here[q] = min(here.get(q, one), one)
        best = here
    return best[""]


def expected(rows):
    convs = {c: [] for c, *_ in rows}
    for c, *turn in damage(rows):
        convs[c].append(turn)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        turns, marks = [(r, t) for _, r, t in own], faults([(r, t) for _, r, t in own])
        n = {t for t, *_ in own if t is not None}
        gaps = max(n) - min(n) + 1 - len(n) if n else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, left = plain(turns)
        lines = "\n".join(f"{r}:{t}" for r, t in left)
        counts = [marks.count(m) for m in "bdt"] + [sum(p not in ("su", "ua", "au") for p in pairs)]
        out.append((c, gaps, *counts, cost, audit, sha(lines)))
    return sorted(out, key=str)


def found(df, **k):
    out = repair(damaged(df), kept=F.col("kept"), **k)
    return sorted((tuple(r) for r in out.report.collect()), key=str), out


def conversations(seed, n, most, roles=("user", "assistant", "system", "tool", "", None, "User")):
    random.seed(seed)
    texts = ["Hi.", "Why?", "no end", " ", "", None, "Hi. ", "a\nb!", "Hi"]
    rows = []
    for c in range(n):
        for t in range(random.randint(1, most)):
            role = random.choice(roles) if random.random() < 0.4 else ("user", "assistant")[t % 2]
            text = random.choice(texts) if random.random() < 0.4 else f"Turn {t}{random.choice(['.', '', '!'])}"
            turn = None if random.random() < 0.03 else t + random.randint(0, 1)
            rows.append((c if c else None, turn, role, text))
    return rows


def test_plain_version_is_the_least_of_all():
    random.seed(8)
    for _ in range(120):
        turns = [
            (random.choice(["user", "assistant", "system", "tool"]), random.choice(["a.", "b.", "c", ""]))
            for _ in range(random.randint(0, 3))
        ]
        cost, audit, left = exhaustive(turns)
        assert plain(turns) == (cost, audit, tuple(left))


def test_equals_the_plain_version(spark, tmp_path):
    rows = conversations(1, 300, 12) + conversations(2, 4, 60)
    assert found(stored(spark, tmp_path / "c", rows, SCHEMA))[0] == expected(rows)


@pytest.mark.parametrize("piece_turns", [1, 7])
def test_conversations_cut_into_pieces(spark, tmp_path, piece_turns):
    rows = conversations(3, 25, 40)
    rows += [(500, None, "user", "same."), (500, None, "user", "same."), (500, 3, "assistant", "x")] * 20
    got, out = found(stored(spark, tmp_path / "c", rows, SCHEMA), piece_turns=piece_turns)
    assert got == expected(rows)
    lines = {}
    for r in sorted(out.turns.collect(), key=lambda r: (r.part, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(t)) for c, t in lines.items()} == {r[0]: r[-1] for r in got if r[0] in lines}


def test_long_conversation_and_long_texts(spark, tmp_path):
    random.seed(5)
    rows = [(1, t, random.choice(["user", "assistant", "system"]), f"{t % 400}." * 3) for t in range(3000)]
    rows += [(2, 0, "user", "long " * 100_000 + "."), (2, 1, "assistant", "long " * 100_000)]
    df = stored(spark, tmp_path / "c", rows, SCHEMA)
    whole, pieces = found(df)[0], found(df, piece_turns=200)[0]
    assert whole == pieces == expected(rows)


def test_nothing_left_and_empty_table(spark, tmp_path):
    gone = [(c, 0, "user", "Hi.") for c in range(200) if crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    schema = SCHEMA + ", kept string, _conv int"
    df = stored(spark, tmp_path / "c", [(*r, "x", 1) for r in gone], schema)
    assert found(df)[0] == [(r[0], 0, 0, 0, 0, 0, 0, "", sha("")) for r in sorted(gone, key=str)]
    assert found(stored(spark, tmp_path / "e", [], schema))[0] == []
