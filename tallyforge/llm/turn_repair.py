r"""Conversation structure repair (operator 13): the cheapest edits that make the roles of a conversation legal, found by layers of cost.

Legal role initials are `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn, or nothing. That grammar has four states (start, after s, after u, after a), so a set of
states is four bits. Layer c holds for each place of a conversation the set of states from which the rest can be made legal at a cost of c at most; it follows from the layers c-1,
c-2 and c-3 by table lookups, one for each edit, as in approximate matching with bit-parallel layers. The first layer that holds the start state at the first place gives the cost, and
walking the bits forward, always by the first edit in ASCII order that stays within the cost, gives the least audit.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only way for blank and duplicate rows), Insert an empty user or assistant turn 2; a truncated row that isn't deleted adds 1.
An audit fixes the repaired roles, since after each state but the start only one role can follow, and at the start a system row can only be kept.

Long conversations: the layers are made for blocks of BLOCK rows from the end on; a block starts from the costs of the four states at its end and gives those at its beginning, which
differ by few units, so a conversation of n rows takes about n times the cost of a block, not n times its whole cost.

Rows move twice. First without their texts (a digest stands for them): one task orders the rows of a conversation and streams them, holding a byte a row, as much as the audit it
returns. Then the texts follow their audit in the same order and are hashed as they come, so no conversation's texts are held at once.

Order: by turn (nulls first), then role, then the SHA-256 of the text, so ties have one order. Defined cases: in `damage` and `repair` a null role or text is one space (in the key of the
damage a null id or turn is one too); rows without an id are one conversation, with a null conv_id; roles count by their first letter, exactly (`User` is none of them, an empty role has
none), such rows can only be deleted or reroled; exactly repeated rows are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 16
START, SYSTEM, USER, ASSISTANT = range(4)
#: For each state the state that the next user or assistant turn leads to, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ALL = 0b1111


def _before(moves: dict[int, int]) -> bytes:
    """For each set of states, the states that a turn leads from into the set; moves: state by state."""
    return bytes(sum(1 << a for a, b in moves.items() if bits >> b & 1) for bits in range(16))


BEFORE_ANY = _before(NEXT)
BEFORE = {"s": _before({START: SYSTEM}), "u": _before({q: b for q, b in NEXT.items() if b == USER}), "a": _before({USER: ASSISTANT})}
#: Cost of each state at the end of a conversation: insertions complete a pair.
AT_END = (0, 2 * INSERT, INSERT, 0)

# A row is a byte: its initial as a letter (`-` for none of them), in upper case if the row is truncated, `x` if it must go.


def code(initial: str, must_go: bool, truncated: bool) -> str:
    if must_go:
        return "x"
    letter = initial if initial in ("s", "u", "a") else "-"
    return (letter.upper() if letter != "-" else "+") if truncated else letter


def layers(codes: str, after: tuple[int, ...]) -> tuple[int, list[bytearray]]:
    """Base and layers of a block: layer c has for each place the states from which everything up to the end costs base + c at most. after: what each state costs at the block's end."""
    n, base = len(codes), min(after)
    found: list[bytearray] = []
    blank = bytearray(n + 1)
    while not found or found[-1][0] != ALL:
        c = len(found)
        row = bytearray(n + 1)
        row[n] = sum(1 << q for q in range(4) if after[q] - base <= c)
        back = [row, *(found[c - k] if c >= k else blank for k in range(1, REROLE + TRUNCATED + 1))]
        for i in range(n - 1, -1, -1):
            letter = codes[i]
            bits = back[DELETE][i + 1] | BEFORE_ANY[back[INSERT][i]]
            if letter != "x":
                truncated = letter == "+" or letter.isupper()
                keep = BEFORE.get(letter.lower())
                if keep:
                    bits |= keep[back[KEEP + truncated][i + 1]]
                bits |= BEFORE_ANY[back[REROLE + truncated][i + 1]]
            row[i] = bits
        found.append(row)
    return base, found


def _to_go(base: int, found: list[bytearray], place: int, state: int) -> int:
    return base + next(c for c, row in enumerate(found) if row[place] >> state & 1)


def _repair(codes: str, block: int) -> tuple[int, str]:
    after, blocks = AT_END, []
    for i in reversed(range(0, len(codes), block)):
        base, found = layers(codes[i : i + block], after)
        blocks.append((codes[i : i + block], base, found))
        after = tuple(_to_go(base, found, 0, q) for q in range(4))
    cost, state, audit = after[START], START, []
    left = cost
    while blocks:
        part, base, found = blocks.pop()
        i = 0
        while i < len(part):
            letter, at = part[i], left - base
            truncated = letter == "+" or letter.isupper()

            def held(place: int, spent: int, q: int, at: int = at, found: list[bytearray] = found) -> bool:
                return at >= spent and bool(found[at - spent][place] >> q & 1)

            kept = SYSTEM if letter.lower() == "s" and state == START else NEXT[state] if letter.lower() == ROLE[NEXT[state]][0] else None
            if held(i + 1, DELETE, state):
                edit, spent, i = "D", DELETE, i + 1
            elif held(i, INSERT, NEXT[state]):
                edit, spent, state = "I", INSERT, NEXT[state]
            elif kept is not None and held(i + 1, truncated, kept):
                edit, spent, state, i = "K", KEEP + truncated, kept, i + 1
            else:
                edit, spent, state, i = "R", REROLE + truncated, NEXT[state], i + 1
            audit.append(edit)
            left -= spent
    while state not in (START, ASSISTANT):
        audit.append("I")
        state = NEXT[state]
    return cost, "".join(audit)


_short = lru_cache(1 << 16)(_repair)


def repair_codes(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and least audit of the codes of a conversation's rows. Those of short conversations recur and are remembered."""
    return (_short if len(codes) <= 64 else _repair)(codes, block)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes `.`, `!`, `?` out, 3 repeats it, 4 makes its role user."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


SPACE = "[\\x20\\x09-\\x0D]"
FAULTS = ("blank", "duplicate", "truncated")
ORDER = ("turn", "role", "digest")


def _order(*first: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*first, *ORDER)]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), again (role and text seen earlier) and fault: blank, duplicate, truncated or null, the first one that counts. All rows of a conversation
    are in one partition."""
    text = F.col("text")
    blank = ~text.rlike(rf"[^\x20\x09-\x0D]")
    cut = ~text.rlike(rf"[.!?]{SPACE}*\z")
    slim = rows.select("conv_id", "turn", "role", F.sha2(text, 256).alias("digest"), blank.alias("_blank"), cut.alias("_cut")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    return slim.withColumn("again", again).select("conv_id", *ORDER, "again", F.when(F.col("_blank"), "blank").when(F.col("again"), "duplicate").when(F.col("_cut"), "truncated").alias("fault"))


class _Open:
    """The conversation that is being read."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.counts, self.illegal, self.last = conv_id, [], dict.fromkeys(FAULTS, 0), 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        initial = role[:1]
        self.codes.append(code(initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.turn:  # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1

    def row(self) -> tuple:
        cost, audit = repair_codes("".join(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *(self.counts[f] for f in FAULTS), self.illegal, cost, audit


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit"]
    kinds = [pa.int64()] * 7 + [pa.string()]
    held: _Open | None = None
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
        done.clear()
        return out

    for b in batches:
        for conv_id, turn, role, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault")), strict=True):
            if held is None or conv_id != held.conv_id:
                if held:
                    done.append(held.row())
                held = _Open(conv_id)
            held.add(turn, role, fault)
        if done:
            yield batch()
    if held:
        done.append(held.row())
        yield batch()


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): gaps, counts of faults, illegal neighbours, cost and audit."""
    kinds = {"conv_id": "long", "turn": "long"}
    ready = faults(rows).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    return ready.sortWithinPartitions(*_order("conv_id"), "again").select("conv_id", "turn", "role", "fault").mapInArrow(_audits, AUDITS)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns. A conversation's audit comes first, then its rows in order."""
    edits: Iterator[str] = iter("")
    conv, number, state = None, 0, START
    out: list[tuple] = []

    def put(role: str, text: str, edit: str) -> None:
        nonlocal number
        out.append((conv, number, role, text, edit))
        number += 1

    def insert() -> None:
        nonlocal state
        state = NEXT[state]
        put(ROLE[state], "", "I")

    for b in batches:
        for conv_id, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True):
            if audit is not None:
                for _ in edits:  # what is left of the conversation before
                    insert()
                edits, conv, number, state = iter(audit), conv_id, 0, START
                continue
            while (edit := next(edits)) == "I":
                insert()
            if edit != "D":
                state = SYSTEM if edit == "K" and state == START and role.startswith("s") else NEXT[state]
                put(role if edit == "K" else ROLE[state], text, edit)
        yield _rows(out)
        out.clear()
    for _ in edits:
        insert()
    yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def repair(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position, role, text, edit (K, R or I), in order within a partition, which has whole conversations. audited: the rows of audits(rows), saved."""
    turns = rows.select(F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long"), "role", F.sha2("text", 256).alias("digest"), "text", F.lit(None).cast("string").alias("audit"))
    heads = audited.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "string"), ("text", "string"))], "audit")
    both = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind"))
    return both.select("conv_id", "role", "text", "audit").mapInArrow(_turns, "conv_id long, position long, role string, text string, edit string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of `role:text` lines, hashed as they come."""
    conv, h, some = None, None, False
    for b in batches:
        ids, digests = [], []
        for conv_id, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
            if position == 0:
                if some:
                    ids.append(conv)
                    digests.append(h.hexdigest())
                conv, h, some = conv_id, hashlib.sha256(), True
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damage(given)
    audited = Scratch(spark, "turn-repair").save(audits(rows), "audits")
    digests = repair(rows, audited).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    ids = given.select(F.col("conv_id").cast("long")).distinct()
    out = ids.join(audited.withColumnRenamed("conv_id", "_a"), F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(digests.withColumnRenamed("conv_id", "_b"), F.col("conv_id").eqNullSafe(F.col("_b")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a plain dynamic programme from the last row on. A value is a cost of six digits, the audit, a tab, and the repaired lines, a line feed before each; the table of crc32 is
    made in place."""
    tab, line = "chr(9)", "chr(10)"

    def put(v: str, cost: str, edit: str, text: str = "''") -> str:
        return (
            f"lpad(CAST(CAST(substr({v}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || '{edit}' || substr({v}, 7, instr({v}, {tab}) - 7) || {tab} || {text} || substr({v}, instr({v}, {tab}) + 1)"
        )

    extra = "(fault IS NOT NULL)::INT"
    stays = "(fault IS NULL OR fault = 'truncated')"
    drop = lambda v: put(v, "3", "D")
    keep = lambda initial, v: f"CASE WHEN {stays} AND role[1] = '{initial}' THEN {put(v, extra, 'K', f'{line} || role || chr(58) || text')} END"
    rerole = lambda role, v: f"CASE WHEN {stays} THEN {put(v, f'2 + {extra}', 'R', line + f" || '{role}:' || text")} END"
    insert = lambda role, v: put(v, "2", "I", f"{line} || '{role}:'")
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT k.* EXCLUDE (key), xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(role[1]) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
  CASE WHEN i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM p),
-- v0 to v3: what the rest costs after the start, s, u and a
g AS (SELECT DISTINCT conv_id, n + 1 AS i, '000000' || {tab} AS v0, '000004II' || {tab} || {line} || 'user:' || {line} || 'assistant:' AS v1, '000002I' || {tab} || {line} || 'assistant:' AS v2,
    '000000' || {tab} AS v3 FROM f
  UNION ALL SELECT conv_id, i, least(w0, {insert("user", "w2")}, {insert("user", "insert_a")}), least(w1, {insert("user", "w2")}, {insert("user", "insert_a")}), least(w2, insert_a),
    least(w3, {insert("user", "w2")}) FROM (SELECT *, {insert("assistant", "w3")} AS insert_a FROM (
      SELECT g.conv_id, f.i, least({drop("v0")}, {keep("s", "v1")}, {keep("u", "v2")}, {rerole("user", "v2")}) AS w0, least({drop("v1")}, {keep("u", "v2")}, {rerole("user", "v2")}) AS w1,
        least({drop("v2")}, {keep("a", "v3")}, {rerole("assistant", "v3")}) AS w2, least({drop("v3")}, {keep("u", "v2")}, {rerole("user", "v2")}) AS w3
      FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i - 1))),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, CAST(sum(bad) AS BIGINT) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(v0, 1, 6) AS BIGINT), 0) AS cost, coalesce(substr(v0, 7, instr(v0, {tab}) - 7), '') AS audit, sha256(coalesce(substr(v0, instr(v0, {tab}) + 2), '')) AS repaired_sha256
FROM e LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = 1
"""


ORACLE = _sql()
