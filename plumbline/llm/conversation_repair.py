"""Conversation structure repair: the cheapest edits that bring a conversation's turns into order.

A conversation is in order if its roles' initials read ``(s?(ua)+)?``. Rows are damaged first, by a hash of their keys (``damaged``),
then judged: blank, duplicate or truncated, whichever comes first. Edits, in the order of their letters: D deletes a row (3; a blank or
duplicate row has to go), I inserts an empty turn (2), K keeps (0), R gives the row the role that fits (2); a truncated row that
stays adds 1. The role that an insertion or a new role gives follows from what stands before it, so the letters tell all.

``repair`` is iterative-deepening A*: depth-first search in the order of the letters under a cost bound that grows to
the least cost that was cut off. Its estimate counts what has to go, what is truncated, and the runs of neighbours that
cannot stand together (an edit mends two at most). ``need`` is its table of failed states: what a place and state is
known to cost at least, raised whenever a search from it fails, so that no state is searched twice with as little left. As the
estimate never exceeds the cost, the first accepting path is the cheapest one and the first by letters. Of a long conversation, each
``STEP`` rows' needs are searched first, from the end, so that bounds grow by what a step lacks and the work by the rows.

Spark damages and judges the rows and orders them by conversation; a task then streams its conversations, holding two bytes and
four bounds a row of the one at hand, and no text. The found letters go back to the rows, and a second stream hashes the repaired texts
without keeping them. The letters and the hash are one cell of a conversation, so that one task has to see all its rows, in order.

Cases: null roles and texts are one space, as are null ids and turns in the hashed key; a null conv_id is a conversation of its own; rows of
one turn stand by role, then by a hash of their text; null turns stand first; repeated rows are rows; a very long text is never held beside others;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, table

#: Where each role's initial leads from a state: the start, after a system, a user or an assistant turn; and the roles that fit next.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FITTING = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ACCEPTING = (True, False, False, True)
_AFTER = {"s": 1, "u": 2, "a": 3}
#: Kinds of rows: sound, truncated (which is also what it adds to the cost), and those that have to go.
SOUND, TRUNCATED, LOST = 0, 1, 2
DELETE, INSERT, REROLE = 3, 2, 2
#: Rows of a long conversation that are searched at a time, the last ones first.
STEP = 128


def least_costs(initials: str, kinds: bytes) -> list[int]:
    """What the rows from each place on cost at least, by state: item 4 * place + state."""
    n = len(initials)
    out, forced, after, run, rest = [0] * (4 * n + 4), 0, None, 0, 0
    for i in range(n, -1, -1):
        if i < n:
            forced += DELETE if kinds[i] == LOST else kinds[i]
            if kinds[i] != LOST:
                # Pairs of neighbours that stay: ``run`` of them in a row do not fit from here on, and ``rest`` mends the later ones.
                state = _AFTER.get(initials[i])
                fits = state is not None and (ACCEPTING[state] if after is None else after in LEADS[state])
                run, rest = (0, rest + INSERT * (-(-run // 2))) if fits else (run + 1, rest)
                after = initials[i]
        for state in range(4):
            fits = ACCEPTING[state] if after is None else after in LEADS[state]
            out[4 * i + state] = forced + rest + INSERT * (-(-(run + (not fits)) // 2))
    return out


def _edits(initials: str, kinds: bytes, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Letter, place and state that it leads to, and cost, in the order of the letters."""
    insert = ("I", i, FITTING[state][1], INSERT)
    if i == len(initials):
        return [insert]
    out = [("D", i + 1, state, DELETE), insert]
    if kinds[i] != LOST:
        if (kept := LEADS[state].get(initials[i])) is not None:
            out.append(("K", i + 1, kept, kinds[i]))
        out.append(("R", i + 1, FITTING[state][1], REROLE + kinds[i]))
    return out


def _deepened(initials: str, kinds: bytes, need: list[int], start: int, state: int, stop: int) -> tuple[int, str]:
    """Least cost from a place and state to the end, and the first letters by which it is reached at ``stop``, whose own needs are exact (or the end)."""
    n, first, bound = len(initials), state, need[4 * start + state]
    while True:
        letters = []
        # Each level: edits left to try, place, state, cost left, and the least that any cut-off path lacked.
        levels = [[iter(_edits(initials, kinds, start, first)), start, first, bound, None]]
        while levels:
            level = levels[-1]
            for letter, i, state, cost in level[0]:
                left = level[3] - cost
                short = need[4 * i + state] - left
                if short > 0:
                    level[4] = short if level[4] is None else min(level[4], short)
                    continue
                letters.append(letter)
                if i == stop and (i < n or ACCEPTING[state]):
                    return bound, "".join(letters)
                levels.append([iter(_edits(initials, kinds, i, state)), i, state, left, None])
                break
            else:
                levels.pop()
                _, i, state, left, lack = level
                need[4 * i + state] = left + lack
                if levels:
                    letters.pop()
                    above = levels[-1]
                    above[4] = lack if above[4] is None else min(above[4], lack)
        bound += lack


def repair(initials: str, kinds: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows with these initials and kinds, the first by letters."""
    n, base = len(initials), least_costs(initials, kinds)
    if not n:
        return 0, ""
    need, stop, more = base.copy(), n, 0
    for start in range((n - 1) // STEP * STEP, -1, -STEP):
        # No edit lowers the estimate by more than it costs, so what all states lacked at ``stop`` is lacked before it.
        for i in range(4 * start, 4 * stop):
            need[i] += more
        for state in range(4) if start else ():
            need[4 * start + state] = _deepened(initials, kinds, need, start, state, stop)[0]
        more, stop = min(need[4 * start + state] - base[4 * start + state] for state in range(4)), start
    return _deepened(initials, kinds, need, 0, 0, n)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by crc32 of ``conv_id:turn``, modulo 20, and dropped (true of rows that are gone: their conversations stay)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(F.encode(key, "utf-8")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), how.alias("how"))
    times = F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("how") == 0).alias("dropped"), times.alias("copy")).drop("copy")


def _named(rows: DataFrame) -> DataFrame:
    """Adds what tells the texts of a conversation's rows apart."""
    return rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _ordered(df: DataFrame, *last: str) -> DataFrame:
    """Conversations one after another, each with its rows in order."""
    return df.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", *last)


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, initial, fault (blank, duplicate, truncated or null) and dropped of the rows, by conversation in their order."""
    word = r"[^\x20\x09-\x0D]"
    own = _named(rows).select("conv_id", "turn", "role", "digest", "dropped", (~F.col("text").rlike(word)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    # A conversation's rows are on one partition, so its equal rows are too.
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated")
    marked = own.repartition("conv_id").withColumn("again", seen)
    # The later of equal rows stands later among the rows of its turn, too.
    return _ordered(marked, "again").select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "dropped")


class _Conversation:
    """What is kept of the conversation at hand."""

    def __init__(self, conv_id):
        self.conv_id, self.initials, self.kinds = conv_id, [], bytearray()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn, initial: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault is not None:
            self.counts[fault] += 1
        self.illegal += bool(self.initials) and (self.initials[-1] + initial) not in ("su", "ua", "au")
        self.initials.append(initial)
        self.kinds.append(SOUND if fault is None else TRUNCATED if fault == "truncated" else LOST)

    def row(self) -> tuple:
        # An initial is one letter, or none of the three where a role is empty.
        cost, audit = repair("".join(x or " " for x in self.initials), bytes(self.kinds))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit)


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _out(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of faults, cost and audit of every conversation of damaged rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_REPORT, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, []
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_REPORT), pa.string()]
            for conv_id, turn, initial, fault, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        done.append(at.row())
                    at = _Conversation(conv_id)
                if not dropped:
                    at.add(turn, initial, fault)
            if len(done) >= 1000:
                yield _out(names, kinds, done)
                done = []
        if at is not None:
            yield _out(names, kinds, [*done, at.row()])

    return judged(rows).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _REPORT)}, audit string")


class _Written:
    """The repaired rows of a conversation, hashed as they come."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state, self.hash, self.any = letters, 0, 0, hashlib.sha256(), False

    def put(self, role: str, text: str, state: int) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.state, self.any = state, True

    def inserted(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.put(FITTING[self.state][0], "", FITTING[self.state][1])
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.put(role, text, LEADS[self.state][role[:1]])
        elif letter == "R":
            self.put(FITTING[self.state][0], text, FITTING[self.state][1])

    def end(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (see ``audits``) with repaired_sha256, the hash of the repaired rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_REPORT, "audit", "repaired_sha256"]
    lines = _named(rows.filter(~F.col("dropped")).drop("dropped")).withColumn("is_row", F.lit(True))
    both = lines.unionByName(found.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    # A report has no turn, no role and no digest: it stands before the rows.
    ordered = _ordered(both.repartition("conv_id")).select("conv_id", "is_row", "role", "text", *_REPORT, "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, report, done = None, None, []
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_REPORT), pa.string(), pa.string()]
            for conv_id, is_row, role, text, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_row:
                    at.add(role, text)
                else:
                    if at is not None:
                        done.append((*report, at.end()))
                    at, report = _Written(own[-1]), (conv_id, *own)
            if len(done) >= 1000:
                yield _out(names, kinds, done)
                done = []
        if at is not None:
            yield _out(names, kinds, [*done, (*report, at.end())])

    return ordered.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repaired(rows, audits(rows))


def _oracle() -> str:
    """The same by the least (cost, letters) of every place and state, from a conversation's last row to its first, and a walk along the letters."""
    role = lambda state: f"CASE {state} WHEN 2 THEN 'assistant' ELSE 'user' END"
    fitting = lambda state: f"CASE {state} WHEN 2 THEN 3 ELSE 2 END"
    kept = "CASE WHEN {s} = 0 AND initial = 's' THEN 1 WHEN {s} IN (0, 1, 3) AND initial = 'u' THEN 2 WHEN {s} = 2 AND initial = 'a' THEN 3 END"
    step = lambda letter, cost, then: f"struct_pack(c := {cost} + {then}.c, l := '{letter}' || {then}.l)"
    keeps = lambda s: [(i, k) for i, k in LEADS[s].items()]

    def stays(s: int) -> str:
        """The best of a row's edits but insertions, from the next place's f0 to f3."""
        keep = "".join(f" WHEN initial = '{i}' THEN {step('K', 'extra', f'f{k}')}" for i, k in keeps(s))
        rerole = step("R", f"{REROLE} + extra", f"f{FITTING[s][1]}")
        keep = f"CASE WHEN lost THEN NULL{keep} END"
        return f"list_min(list_filter([{step('D', DELETE, f'f{s}')}, {keep}, CASE WHEN NOT lost THEN {rerole} END], lambda x: x IS NOT NULL)) AS g{s}"

    insert = lambda s, then: f"least(g{s}, {step('I', INSERT, then)}) AS f{s}"
    # Two insertions in a row help after a system turn alone, so states 2 and 3 are settled before 0 and 1.
    settled = lambda source: f"SELECT conv_id, n, place, g0, g1, {insert(2, 'g3')}, {insert(3, 'g2')} FROM ({source})"
    whole = lambda source: f"SELECT conv_id, n, place, {insert(0, 'f2')}, {insert(1, 'f2')}, f2, f3 FROM ({settled(source)})"
    end = ", ".join(f"struct_pack(c := {0 if ok else 1 << 40}::BIGINT, l := '') AS g{s}" for s, ok in enumerate(ACCEPTING))
    word = r"[^\x20\x09-\x0D]"
    state = lambda s: f"CASE letter WHEN 'D' THEN {s} WHEN 'K' THEN {kept.format(s=s)} ELSE {fitting(s)} END"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations),
hurt AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (VALUES (1), (2)) c(copy) WHERE how <> 0 AND (copy = 1 OR how = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial FROM placed),
judged AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
edited AS MATERIALIZED (SELECT conv_id, i, initial, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS lost, coalesce((fault = 'truncated')::BIGINT, 0) AS extra FROM judged),
costs AS ({whole(f"SELECT DISTINCT conv_id, n, n + 1 AS place, {end} FROM judged")}
  UNION ALL {whole(f"SELECT c.conv_id, n, place - 1 AS place, {', '.join(stays(s) for s in range(4))} FROM costs c JOIN edited e ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = c.place - 1")}),
audits AS MATERIALIZED (SELECT conv_id, f0.c AS cost, f0.l AS audit FROM costs WHERE place = 1),
walk AS (SELECT conv_id, audit, 0 AS p, 1 AS i, 0 AS state, NULL::VARCHAR AS role, NULL::BIGINT AS line FROM audits
  UNION ALL SELECT conv_id, audit, p + 1, CASE letter WHEN 'I' THEN i ELSE i + 1 END, {state("state")}, CASE letter WHEN 'D' THEN NULL WHEN 'K' THEN '' ELSE {role("state")} END, CASE WHEN letter IN ('K', 'R') THEN i END
  FROM (SELECT w.conv_id, audit, p, w.i, state, audit[p + 1] AS letter, e.initial FROM walk w LEFT JOIN edited e ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.i = e.i WHERE p < length(audit))),
written AS (SELECT w.conv_id, sha256(string_agg(CASE w.role WHEN '' THEN j.role ELSE w.role END || ':' || coalesce(j.text, ''), chr(10) ORDER BY p)) AS repaired_sha256
  FROM walk w LEFT JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND w.line = j.i WHERE w.role IS NOT NULL GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT o.conv_id, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _REPORT)}, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN written w ON o.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLE = _oracle()
