"""Operator 12: faults of conversations and their cheapest repair.

The grammar of roles is ``(s?(ua)+)?`` over the first letters of the roles.  Its states
are bits of a mask: start, after s, after u, after a.  For a row and a cost there
is a bitset of the states from which what follows can be made right at that
cost.  Layer by layer, for cost 0, 1, 2, ..., the bitsets of all rows come from those
of the layers below it; the first layer that holds the start state gives the
cost.  A trace over the bits from the first row on takes the least letter that
stays on a cheapest way, which is the least audit.

Plan: one shuffle by conversation.  Inside a task rows are sorted from the last
turn to the first; ``_layers`` reads them as a stream, ``BLOCK`` rows at a time,
and keeps of what follows only its four least costs (they differ by less than
``SPAN``), so its work is linear in the rows and its memory doesn't depend on a
conversation's length.  Then the same rows are sorted from the first to
the last and ``_trace`` follows the bits, counts and hashes.  Both sorts
spill, neither stage holds a conversation.  One conversation stays in one task, as the hash
of its repaired text is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import map_arrow, q, table, tune
from quarryline.llm.merkle import CRC32

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows whose layers are built together.
BLOCK = 32
#: Least costs of the four states behind a row differ by less than this; four bits of a word for each.
SPAN = 16
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ALL = 15
#: The state behind a row of this role, by the state before it.
NEXT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
#: The only role that user or assistant may have in a state, for rows that are inserted or get another role.
OWED = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _before(moves: dict[int, int]) -> list[int]:
    """For each bitset of states, the bitset of those that a move leads into it."""
    return [sum(1 << s for s, t in moves.items() if m >> t & 1) for m in range(16)]


_KEEP = {role: _before(moves) for role, moves in NEXT.items()}
_OWED = _before({s: NEXT[r][s] for s, r in OWED.items()})
_NONE = [0] * 16

#: Bitsets by cost behind the last row: the accepting states, then those that inserts lead to them.
_END = {0: 1 << START | 1 << AFTER_A, INSERT: 1 << AFTER_U, 2 * INSERT: 1 << AFTER_S}


def pack(masks: dict[int, int]) -> int:
    """Bitsets by cost as one word, from the least cost on."""
    least = min(masks)
    return sum(m << 4 * (c - least) for c, m in masks.items())


END = pack(_END)


def layers(codes: list[tuple[str, str]], behind: int) -> tuple[list[int], int]:
    """Words of bitsets behind each row (role letter, fault) of a block, and the one before its first row.

    ``behind`` is the word behind the last row.  A state counts in the first layer that it appears in.
    """
    n = len(codes)
    keep = [_NONE if f in ("blank", "duplicate") else _KEEP.get(r, _NONE) for r, f in codes]
    swap = [_NONE if f in ("blank", "duplicate") else _OWED for r, f in codes]
    more = [TRUNCATED if f == "truncated" else 0 for r, f in codes]
    seen = [0] * (n + 1)
    at: list[list[int]] = [[] for _ in range(n + 1)]  # at[i][cost]: bitset of states before row i
    cost, left = 0, n + 1
    while left:
        for i in range(n, -1, -1):
            row = at[i]
            if seen[i] == ALL:
                row.append(0)
                continue
            if i == n:
                new = behind >> 4 * cost & ALL
            else:
                nxt, t = at[i + 1], more[i]
                new = keep[i][nxt[cost - t]] if cost >= t else 0
                if cost >= REROLE + t:
                    new |= swap[i][nxt[cost - REROLE - t]]
                if cost >= DELETE:
                    new |= nxt[cost - DELETE]
                if cost >= INSERT:
                    new |= _OWED[row[cost - INSERT]]
            new &= ~seen[i]
            row.append(new)
            seen[i] |= new
            left -= seen[i] == ALL
        cost += 1
    words = [pack({c: m for c, m in enumerate(row) if m}) for row in at]
    return words[1:], words[0]


def least_costs(word: int) -> list[int]:
    """Cost of each state over the least one of the word."""
    out = [0] * 4
    for c in range(SPAN):
        for s in range(4):
            if word >> 4 * c & 1 << s:
                out[s] = c
    return out


@lru_cache(maxsize=1 << 14)
def steps(letter: str, fault: str, state: int, behind: int) -> tuple[list[str], int, int]:
    """Letters of the least audit from ``state`` up to and with this row, the state behind it, and their cost."""
    cost = least_costs(behind)
    may = fault not in ("blank", "duplicate")
    t = TRUNCATED if fault == "truncated" else 0

    def rowwise(s: int) -> list[tuple[int, str, int, int]]:
        """(cost to the end, letter, next state, own cost) of every edit of the row itself."""
        found = [(DELETE + cost[s], "D", s, DELETE)]
        if may and s in NEXT.get(letter, {}):
            found.append((t + cost[NEXT[letter][s]], "K", NEXT[letter][s], t))
        if may:
            to = NEXT[OWED[s]][s]
            found.append((REROLE + t + cost[to], "R", to, REROLE + t))
        return found

    def total(s: int, inserts: int = 3) -> int:
        best = min(x[0] for x in rowwise(s))
        return best if not inserts else min(best, INSERT + total(NEXT[OWED[s]][s], inserts - 1))

    letters, spent = [], 0
    while True:
        best = total(state)
        done = min((x for x in rowwise(state) if x[0] == best), key=lambda x: x[1], default=None)
        inserted = NEXT[OWED[state]][state]
        if (not done or done[1] > "I") and INSERT + total(inserted) == best:
            letters.append("I")
            spent += INSERT
            state = inserted
            continue
        letters.append(done[1])
        return letters, done[2], spent + done[3]


def _letter(role: Column) -> Column:
    return F.substring(role, 1, 1)


WHITE = " \t\n\x0b\x0c\r"


def fault_column(text: Column, again: Column) -> Column:
    """The first fault that a row has, else an empty text."""
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return F.when(last == "", "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def _runs(convs: list[str | None], longest: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows of one conversation, cut to ``longest``."""
    lo = 0
    for i in range(1, len(convs) + 1):
        if i == len(convs) or convs[i] != convs[lo] or (longest and i - lo == longest):
            yield lo, i
            lo = i


def _layers_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last row to the first: each row with the word of bitsets behind it."""
    now, word = (), END
    for b in batches:
        convs, gone, faults = (b.column(c).to_pylist() for c in ("conv", "gone", "fault"))
        letters = b.column("letter").to_pylist()
        behind = []
        for lo, hi in _runs(convs, BLOCK):
            if now != (convs[lo],):
                now, word = (convs[lo],), END
            live = [i for i in range(lo, hi) if not gone[i]]
            words, first = layers([(letters[i], faults[i]) for i in reversed(live)], word)
            at = dict(zip(reversed(live), words, strict=True))
            behind += [at.get(i, 0) for i in range(lo, hi)]
            word = first
        # a word has 64 bits; Arrow's long is signed
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w - (1 << 64) if w >> 63 else w for w in behind], pa.int64())], names=[*b.schema.names, "behind"])


class _Conversation:
    """What the trace keeps of a conversation: counts, the state, a hash."""

    def __init__(self, conv: str | None) -> None:
        self.conv, self.state, self.cost, self.audit, self.sha, self.lines = conv, START, 0, [], hashlib.sha256(), 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.last = None

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> None:
        self.line(ROLE[OWED[self.state]], "")
        self.state = NEXT[OWED[self.state]][self.state]

    def row(self, turn: int | None, letter: str, role: str, text: str, fault: str, behind: int) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if fault:
            self.counts[fault] += 1
        self.illegal += self.last is not None and (self.last, letter) not in LEGAL
        self.last = letter
        edits, state, cost = steps(letter, fault, self.state, behind)
        for _ in edits[:-1]:
            self.insert()
        if edits[-1] == "K":
            self.line(role, text)
        elif edits[-1] == "R":
            self.line(ROLE[OWED[self.state]], text)
        self.state, self.cost = state, self.cost + cost
        self.audit += edits

    def end(self) -> dict:
        while self.state in (AFTER_S, AFTER_U):
            self.insert()
            self.audit.append("I")
            self.cost += INSERT
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


_OUT = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _trace_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the first row to the last: a row for each conversation."""
    now: _Conversation | None = None
    for b in batches:
        done, columns = [], [b.column(c).to_pylist() for c in ("conv", "gone", "turn", "letter", "role", "text", "fault", "behind")]
        for conv, gone, *row in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.end())
                now = _Conversation(conv)
            if not gone:
                row[-1] &= (1 << 64) - 1
                now.row(*row)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_OUT)
    if now:
        yield pa.RecordBatch.from_pylist([now.end()], schema=_OUT)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows count by turn, then role and text; ``gone_col`` marks rows that are no more, whose conversation still comes out.

    Nulls: a null role or text is one space (so the text is blank); null turns stand first and make no gap; rows without an id are one conversation.
    Empty texts are blank, long ones are judged and hashed whole.  Repeated rows: all but the first are duplicates (or blank).
    A conversation of no rows has zeros, an empty audit and the hash of nothing.  An empty table gives an empty one.
    Other columns are ignored, whatever their names.
    """
    tune(turns.sparkSession)
    kind = turns.schema[conv_col].dataType
    gone = F.col(q(gone_col)) if gone_col else F.lit(False)
    space = lambda c: F.coalesce(F.col(q(c)).cast("string"), F.lit(" "))
    rows = turns.select(F.col(q(conv_col)).cast("string").alias("conv"), F.col(q(turn_col)).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), gone.alias("gone"))
    rows = rows.repartition("conv").withColumn("key", F.md5(F.col("text").cast("binary")))
    again = F.row_number().over(Window.partitionBy("conv", "role", "key", "gone").orderBy(F.col("turn").asc_nulls_first())) > 1
    rows = rows.withColumn("again", again)
    up = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("again").asc()]
    down = [F.col("conv").desc_nulls_last(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("again").desc()]
    rows = rows.select("conv", "turn", "role", "text", "gone", "again", fault_column(F.col("text"), F.col("again")).alias("fault"), _letter(F.col("role")).alias("letter"))
    fields = "conv string, turn long, role string, text string, gone boolean, again boolean, fault string, letter string"
    rows = map_arrow(rows.sortWithinPartitions(*down), _layers_stage, f"{fields}, behind long")
    out = map_arrow(rows.sortWithinPartitions(*up), _trace_stage, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(F.col("conv").cast(kind).alias(conv_col), *out.columns[1:])


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the contract's damage: dropped (marked ``gone``), emptied, without stops, repeated, or by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage; nulls and the rest as in ``repair``."""
    return repair(damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), gone_col="gone")


def _plus(cost: str, word: str, letter: str) -> str:
    return f"printf('%06d', substr({word}, 1, 6)::INT + {cost}) || '{letter}' || substr({word}, 7)"


def _row_sql(state: int) -> str:
    """Least of (cost, audit) from a state through a row, before inserts; both as one text that compares rightly."""
    keeps = " ".join(f"WHEN may AND letter = '{r}' THEN {_plus('t', f'v{moves[state]}', 'K')}" for r, moves in NEXT.items() if state in moves)
    to = NEXT[OWED[state]][state]
    return f"least({_plus(str(DELETE), f'v{state}', 'D')}, CASE {keeps} END, CASE WHEN may THEN {_plus(f'{REROLE} + t', f'v{to}', 'R')} END)"


SQL_OP12 = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(text="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(2) c(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, left(role, 1) AS letter, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS stop, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM o),
g AS (SELECT *, CASE WHEN stop = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
h AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS may, (fault = 'truncated')::INT AS t FROM g),
r AS (SELECT conv_id, n + 1 AS pos, '000000' AS v0, '000004II' AS v1, '000002I' AS v2, '000000' AS v3 FROM h WHERE pos = n
 UNION ALL SELECT conv_id, pos, least(w0, {_plus("2", "w2", "I")}), least(w1, {_plus("2", "w2", "I")}), w2, w3 FROM (
  SELECT conv_id, pos, w0, w1, least(w2, {_plus("2", "w3", "I")}) AS w2, least(w3, {_plus("2", "w2", "I")}) AS w3 FROM (
   SELECT h.conv_id, h.pos, {_row_sql(0)} AS w0, {_row_sql(1)} AS w1, {_row_sql(2)} AS w2, {_row_sql(3)} AS w3 FROM r JOIN h ON r.conv_id IS NOT DISTINCT FROM h.conv_id AND r.pos = h.pos + 1))),
a AS (SELECT conv_id, substr(v0, 1, 6)::BIGINT AS cost, substr(v0, 7) AS audit FROM r WHERE pos = 1),
l AS (SELECT conv_id, audit, 0 AS i, 0::BIGINT AS pos, 0 AS state, []::VARCHAR[] AS lines FROM a
 UNION ALL SELECT conv_id, audit, i + 1, CASE WHEN e = 'I' THEN pos ELSE pos + 1 END, CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE letter WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
  CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (SELECT l.*, h.letter, h.role, h.text, substr(l.audit, l.i + 1, 1) AS e FROM l LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM l.conv_id AND h.pos = l.pos + 1 WHERE l.i < length(l.audit))),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (pos > 1 AND prev || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY conv_id)
SELECT c.conv_id, coalesce(z.gaps, 0)::BIGINT AS gaps, coalesce(z.blank, 0)::BIGINT AS blank, coalesce(z.duplicate, 0)::BIGINT AS duplicate, coalesce(z.truncated, 0)::BIGINT AS truncated, coalesce(z.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(array_to_string(l.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = length(l.audit)
"""
