import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestrata.llm import conversation_repair as h

SCHEMA = "conv_id long, turn long, role string, text string, letters string, pos long, cost string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 4:
            role = "user"
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def scripts(rows, most):
    """Every sequence of edits of at most `most` cost that gives a legal conversation: (cost, audit, text)."""
    done = []

    def go(k, cost, audit, turns):
        if cost > most:
            return
        roles = "".join(r[:1] or "?" for r, _ in turns)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            done.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)))
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        for role in ("user", "assistant"):
            go(k, cost + 3, audit + "I", [*turns, (role, "")])
        if k < len(rows):
            role, text, fault = rows[k]
            go(k + 1, cost + 4, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                go(k + 1, cost + extra, audit + "K", [*turns, (role, text)])
                for new in ("user", "assistant"):
                    go(k + 1, cost + extra + 3, audit + "R", [*turns, (new, text)])

    go(0, 0, "", [])
    return min(done)


def brute(rows):
    out = {}
    kept = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for _, _, role, text in own:
            solid = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        first = [r[2][:1] for r in own]
        count = [sum(f == name for *_, f in judged) for name in ("blank", "duplicate", "truncated")]
        cost, audit, text = next(filter(None, (attempt(judged, most) for most in range(0, 60, 6))))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def attempt(judged, most):
    try:
        return scripts(judged, most)
    except ValueError:
        return None


def table(n, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 6)):
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn * 2, None, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ux"]), r.choice(["Yes.", "No!", "So", "a\n?\r\n", " \t", "", None, "é…", "x.y"])))
    return rows + rows[:3]


def test_against_all_scripts(spark):
    rows = table(120, 3)
    df = spark.createDataFrame([(*r, "z", 1, "z") for r in rows], SCHEMA).repartition(7)
    got = {x.conv_id: tuple(x)[1:] for x in h.repair_damaged(df).collect()}
    assert got == brute(rows)


def test_repaired_turns_are_legal_and_give_the_digest(spark):
    rows = table(60, 9)
    df = spark.createDataFrame([(*r, "z", 1, "z") for r in rows], SCHEMA)
    verdicts, turns = h.repair(h.damaged(df))
    lines, audit = {}, {}
    for t in sorted(turns.collect(), key=lambda t: t.place):
        lines.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
        audit[t.conv_id] = audit.get(t.conv_id, "") + t.edit
    digests = {x.conv_id: x.repaired_sha256 for x in h.repair_damaged(df).collect()}
    for v in verdicts.collect():
        own = lines.get(v.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in own))
        assert audit.get(v.conv_id, "") == v.audit.replace("D", "")
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == digests[v.conv_id]


def test_one_conversation_of_a_third_of_all_rows(spark):
    rows = [(7, k % 5000, ("user", "assistant")[k % 2], f"turn {k % 4000}{'.' if k % 9 else ''}") for k in range(9000)] + [(k, 0, "user", "x.") for k in range(10, 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in h.repair_damaged(df).collect()}
    assert len(got) == 2991
    kept = damage([r for r in rows if r[0] == 7])
    assert got[7].duplicate == len(kept) - len(set(r[2:] for r in kept if r[3])) - sum(not r[3] for r in kept)
    assert len(got[7].audit.replace("I", "")) == len(kept) and got[7].cost > 4 * got[7].duplicate


def test_each_shared_end_is_worked_out_once(monkeypatch):
    """Sorted from their ends, signatures of one task share nodes: steps are made for distinct suffixes alone."""
    a = h.Automaton()
    words = sorted("".join(w)[::-1] for n in range(5) for w in itertools.product("suaoSUx", repeat=n))
    made = 0
    for w in words:
        had = len(a.path)
        before = a.letters
        a.judge(w)
        shared = next((k for k, (x, y) in enumerate(zip(before, w)) if x != y), min(len(before), len(w)))
        assert len(a.path) == len(w) + 1 and had >= shared
        made += len(w) - shared
    assert made == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert len(a.costs) < 40  # classes of nodes that behave alike


def test_edges(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert h.repair_damaged(spark.createDataFrame([], kinds)).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = {x.conv_id: tuple(x)[1:] for x in h.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Yes.")], kinds)).collect()}
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    plain = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 5)
    long = [(plain, 0, "user", "word " * 400_000 + "end.")]
    row = h.repair_damaged(spark.createDataFrame(long, kinds)).first()
    assert row.audit == "KI" and row.cost == 3 and row.repaired_sha256 == hashlib.sha256(f"user:{long[0][3]}\nassistant:".encode()).hexdigest()


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool"])
def test_a_single_row(spark, role):
    rows = [(k, 0, role, "Yes.") for k in range(40)]
    got = {x.conv_id: tuple(x)[1:] for x in h.repair_damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == brute(rows)
