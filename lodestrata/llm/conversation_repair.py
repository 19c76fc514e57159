"""Cheapest repair of conversations whose turns are blank, repeated, cut off or out of turn.

Each row becomes a letter, its role's initial and its first fault, and each conversation a signature of letters. The cost of
what is left to repair depends only on the rest of a signature and on the grammar's state, so signatures share their ends: in
the automaton of distinct signatures read from the end, a node is a suffix, and the cheapest cost and the first edit of the best
audit are found once for each node and state, whatever the number of conversations that end so. Signatures are dealt out by
ranges of their reversed text; in sorted order a node's signatures are neighbours, and only the path of the current one is held.
Nodes whose costs differ by a constant behave alike, so an edit is worked out once for each such class and letter.

A conversation may hold a third of all rows: rows are ordered by ranges, so it spreads over many tasks, its signature
is put together from bounded pieces, and its repaired text is only streamed past (one digest is made in one task).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship
from lodestrata.tables import scratch, stored

SPACE = r"[\x20\x09-\x0D]"
SOUND, CUT, REPEATED, BLANK = "suao", "SUAO", "1234", "5678"  #: letters of a signature by fault, for initials s, u, a and others
PIECE = 1 << 16  #: rows whose letters are joined at a time

INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3  #: costs

_START, _SYSTEM, _USER, _ASSISTANT = range(4)  #: states of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a
_KEEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  #: after an inserted or rerolled turn
_FAR = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: nulls of role and text as one space; by crc32(conv_id:turn) mod 20 a row is left out
    (times 0), emptied, stripped of .!?, repeated (times 2) or given to the user."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(name.cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("times"))


def ordered(rows: DataFrame) -> DataFrame:
    """rows with pos, which rises by conv_id, turn (nulls first), role and text over all tasks; written."""
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(dealt.withColumn("pos", F.monotonically_increasing_id()), "op13-rows")


def _letter(initial: Column, letters: str) -> Column:
    return F.when(initial == "s", letters[0]).when(initial == "u", letters[1]).when(initial == "a", letters[2]).otherwise(letters[3])


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, letters (a row each, in order) and gaps of every conversation of `ordered` rows."""
    initial = F.left("role", F.lit(1))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    key = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    narrow = stored(rows.select("conv_id", "turn", "pos", "times", initial.alias("initial"), blank.alias("blank"), cut.alias("cut"), key.alias("key")), "op13-narrow")
    live = narrow.where("times > 0")
    firsts = stored(live.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first")), "op13-firsts")
    again = F.when(F.col("blank"), _letter(F.col("initial"), BLANK)).otherwise(_letter(F.col("initial"), REPEATED))
    own = F.when(F.col("blank") | F.col("first").isNull(), again).when(F.col("cut"), _letter(F.col("initial"), CUT)).otherwise(_letter(F.col("initial"), SOUND))
    letters = F.when(F.col("times") == 0, "").when(F.col("times") == 1, own).otherwise(F.concat(own, again))
    told = narrow.join(firsts.hint("merge"), "pos", "left").select("conv_id", "pos", letters.alias("letters"))
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "letters"))), lambda x: x["letters"]), "")
    pieces = told.groupBy("conv_id", F.expr(f"pos div {PIECE}").alias("piece")).agg(joined("pos").alias("letters"))
    whole = pieces.groupBy("conv_id").agg(joined("piece").alias("letters"))
    turns = live.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    whole, turns = stored(whole, "op13-letters"), stored(turns.withColumnRenamed("conv_id", "conv"), "op13-turns")
    return whole.join(turns.hint("merge"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", "letters", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


class Automaton:
    """Nodes on the path of one signature from its end on: each has a class, which gives its costs but for a constant, that
    constant, and by grammar state the first edit of the best audit."""

    def __init__(self):
        self.classes: dict[tuple[int, ...], int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.edits: dict[tuple[int, str], tuple[int, int, str]] = {}  # (class, letter) -> class, what its costs rise by, edits by state
        self.path: list[tuple[int, int, str]] = [(*self._named((0, 6, 3, 0)), "-II-")]  # at the end: nothing to do, or the turns that are missing
        self.letters = ""  # of the path, from the end

    def _named(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        plain = tuple(c - least for c in costs)
        if plain not in self.classes:
            self.classes[plain] = len(self.costs)
            self.costs.append(plain)
        return self.classes[plain], least

    def _step(self, node: int, letter: str) -> tuple[int, int, str]:
        rest = self.costs[node]
        best = [(DELETE + rest[g], "D") for g in range(4)]
        if letter != "x":
            extra, initial = TRUNCATED * letter.isupper(), letter.lower()
            for g in range(4):
                if (g, initial) in _KEEP:
                    best[g] = min(best[g], (extra + rest[_KEEP[g, initial]], "K"))
                best[g] = min(best[g], (extra + REROLE + rest[_NEXT[g]], "R"))
        before = list(best)
        for g in (_USER, _ASSISTANT):
            best[g] = min(before[g], (INSERT + before[_NEXT[g]][0], "I"))
        for g in (_START, _SYSTEM):
            best[g] = min(before[g], (INSERT + best[_USER][0], "I"))
        new, rise = self._named(tuple(c for c, _ in best))
        return new, rise, "".join(e for _, e in best)

    def judge(self, letters: str) -> tuple[int, str]:
        """Cost and audit of a signature given from its end; what it shares with the last one isn't worked out again."""
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (self.letters, letters))
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        same = int(apart[0]) if len(apart) else n
        del self.path[same + 1 :]
        node, cost, _ = self.path[-1]
        for letter in letters[same:]:
            known = self.edits.get((node, letter))
            if known is None:
                known = self.edits[node, letter] = self._step(node, letter)
            node, cost = known[0], cost + known[1]
            self.path.append((node, cost, known[2]))
        self.letters = letters
        audit, g, at = [], _START, len(letters)
        while True:
            edit = self.path[at][2][g]
            if edit == "-":
                break
            audit.append(edit)
            if edit == "K":
                g = _KEEP[g, letters[at - 1].lower()]
            elif edit != "D":
                g = _NEXT[g]
            at -= edit != "I"
        return self.costs[node][_START] + cost, "".join(audit)


def audits(letters: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature (a column of that name: letters, x for a row that must go)."""

    def judge(batches):
        automaton = Automaton()
        for b in batches:
            told = [automaton.judge(x) for x in b.column("turned").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array([c for c, _ in told], pa.int64()), pa.array([a for _, a in told], pa.string())], ["signature", "cost", "audit"])

    rows = letters.groupBy("signature").count().select("signature", F.reverse("signature").alias("turned"))
    dealt = rows.repartitionByRange(F.left("turned", F.lit(48))).sortWithinPartitions("turned")
    return stored(dealt.mapInArrow(judge, "signature string, cost long, audit string"), "op13-audits")


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of `ordered` rows."""
    told = stored(signatures(rows).withColumn("signature", F.translate("letters", REPEATED + BLANK, "x" * 8)), "op13-signatures")
    size = F.char_length("letters")
    of = lambda some: (size - F.char_length(F.translate("letters", some, ""))).cast("long")
    initials = F.translate("letters", CUT + REPEATED + BLANK, SOUND * 3)
    pairs = lambda two: (size - F.char_length(F.replace(initials, F.lit(two), F.lit("")))) / 2
    illegal = F.greatest(size - 1, F.lit(0)) - pairs("su") - pairs("ua") - pairs("au")
    both = told.join(audits(told).hint("merge"), "signature")
    return both.select("conv_id", "gaps", of(BLANK).alias("blank"), of(REPEATED).alias("duplicate"), of(CUT).alias("truncated"), illegal.cast("long").alias("illegal"), "cost", "audit")


class Repair:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def _new(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == _USER else "assistant"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns up to that of this row."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[self.state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._new(), text

    def end(self) -> Iterator[tuple[str, str, str]]:
        return self._inserted()


_HEAD = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _with_heads(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each conversation's verdict (pos -1), then its rows in order, in one task."""
    heads = verdicts.select(F.lit(-1).cast("long").alias("pos"), *_HEAD, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("times"))
    turns = rows.where("times > 0").select("pos", "conv_id", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _HEAD[1:]), "role", "text", "times")
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def repaired_turns(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit, role, text of the repaired conversations."""

    def repair(batches):
        now, conv, place = None, None, 0
        for b in batches:
            out: list[tuple] = []

            def put(turns):
                nonlocal place
                for edit, role, text in turns:
                    place += 1
                    out.append((conv, place, edit, role, text))

            for pos, c, audit, role, text, times in zip(*(b.column(n).to_pylist() for n in ("pos", "conv_id", "audit", "role", "text", "times")), strict=True):
                if pos < 0:
                    if now:
                        put(now.end())
                    now, conv, place = Repair(audit), c, 0
                for _ in range(times):
                    put(now.row(role, text))
            yield _turns(out)
        if now:
            out = []
            for edit, role, text in now.end():
                place += 1
                out.append((conv, place, edit, role, text))
            yield _turns(out)

    return _with_heads(rows, verdicts).mapInArrow(repair, "conv_id long, place long, edit string, role string, text string")


def _turns(out: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("conv_id", "place", "edit", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)


def repaired_digests(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdicts with repaired_sha256, the digest of the repaired turns as role:text, one to a line."""

    def digest(batches):
        now, head, sha, first = None, None, None, True

        def put(turns):
            nonlocal first
            for _, role, text in turns:
                sha.update((("" if first else "\n") + role + ":" + text).encode())
                first = False

        for b in batches:
            out: list[tuple] = []
            for pos, role, text, times, *own in zip(*(b.column(n).to_pylist() for n in ("pos", "role", "text", "times", *_HEAD)), strict=True):
                if pos < 0:
                    if now:
                        put(now.end())
                        out.append((*head, sha.hexdigest()))
                    now, head, sha, first = Repair(own[-1]), own, hashlib.sha256(), True
                for _ in range(times):
                    put(now.row(role, text))
            yield _verdicts(out)
        if now:
            put(now.end())
            yield _verdicts([(*head, sha.hexdigest())])

    return _with_heads(rows, verdicts).mapInArrow(digest, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _verdicts(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64() if k < 7 else pa.string()) for k in range(9)], [*_HEAD, "repaired_sha256"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, repaired turns) of rows with conv_id, turn, role, text and times (how often a row stands there, 0 for a row that is gone).

    Rows of one turn are ordered by role, then text; repeated rows are duplicates of the first; a null conv_id is a
    conversation of its own; only a role's first character counts for the grammar. Other columns are ignored, an empty table
    gives no rows, a conversation without rows has an empty audit.
    """
    ship(rows.sparkSession)
    told = ordered(rows)
    verdicts = stored(judged(told), "op13-verdicts")
    return verdicts, repaired_turns(told, verdicts)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The verdict on each conversation after `damaged`, with the digest of its repair; edges as in `repair`."""
    ship(conversations.sparkSession)
    with scratch(conversations.sparkSession) as kept:
        told = ordered(damaged(conversations))
        verdicts = stored(judged(told), "op13-verdicts")
        out = stored(repaired_digests(told, verdicts), "op13-repaired")
        kept.append(out)
    return out


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    """The same by recursion over the rows from the last to the first, with the best (cost, audit, text) by grammar state."""
    put = lambda cost, edit, line, then: f"{{'c': {cost} + {then}.c, 'a': '{edit}' || {then}.a, 't': {line} || {then}.t}}"
    line = lambda role: f"chr(10) || {role} || ':' || r.text"
    plain = []
    for g, keeps in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})):
        kept = " ".join(f"WHEN '{i}' THEN {put('3 * r.cut', 'K', line('r.role'), f's{to}')}" for i, to in keeps.items())
        role, to = ("assistant", 3) if g == 2 else ("user", 2)
        plain.append(f"list_min([{put(4, 'D', chr(39) * 2, f's{g}')}, CASE WHEN NOT r.gone THEN CASE left(r.role, 1) {kept} END END, CASE WHEN NOT r.gone THEN {put('3 + 3 * r.cut', 'R', line(chr(39) + role + chr(39)), f's{to}')} END]) AS p{g}")
    new = lambda role, then: put(3, "I", f"chr(10) || '{role}:'", then)
    end = lambda c, a, t: f"{{'c': {c}::BIGINT, 'a': '{a}', 't': {t}}}"
    return f"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS code FROM b),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS short,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, lag(i) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
r AS (SELECT *, blank OR again AS gone, CAST(short AND NOT blank AND NOT again AS BIGINT) AS cut FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut)::BIGINT AS truncated,
    count(*) FILTER (before IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations),
z AS (SELECT a.conv_id, coalesce(t.n, 0) AS i, {end(0, '', "''")} AS s0, {end(6, 'II', "chr(10) || 'user:' || chr(10) || 'assistant:'")} AS s1, {end(3, 'I', "chr(10) || 'assistant:'")} AS s2, {end(0, '', "''")} AS s3 FROM a LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
    UNION ALL SELECT conv_id, i, {{'c': least0.c, 'a': least0.a, 't': least0.t}}, {{'c': least1.c, 'a': least1.a, 't': least1.t}}, m2, m3 FROM (
        SELECT conv_id, i, list_min([p0, {new('user', 'm2')}]) AS least0, list_min([p1, {new('user', 'm2')}]) AS least1, m2, m3 FROM (
            SELECT *, list_min([p2, {new('assistant', 'p3')}]) AS m2, list_min([p3, {new('user', 'p2')}]) AS m3 FROM (
                SELECT z.conv_id, z.i - 1 AS i, {', '.join(plain)} FROM z JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.i)))),
o AS (SELECT conv_id, s0 FROM z WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s0.c AS cost, s0.a AS audit, sha256(substr(s0.t, 2)) AS repaired_sha256
FROM o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = _sql()
