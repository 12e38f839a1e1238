"""Repair of conversations: an error-correcting Earley parser over a weighted grammar of roles.

Rows are damaged, measured and told apart in the JVM; each conversation then streams through one chart in order of its
turns. The grammar is right-linear, so a nonterminal is always last in its rule and its completion goes straight to
the top (Leo's treatment of right recursion): an item needs no origin, and a column never holds more items than the
grammar has dots. Every item carries its cheapest edits: cost, the rank of their audit among the column's, their trail
and the running digest of the repaired lines. So a conversation of any length takes time in proportion to its rows
and, but for one letter of audit a row, constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.llm.crc_sql import crc32_tables
from prudence.llm.features import released
from prudence.llm.scratch import stored

#: The roles that an edit may give, by the terminal they stand for.
ROLES = {"u": "user", "a": "assistant"}
#: What each edit costs, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Neighbours that may stand side by side.
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
DONE = ("", 0, 0)
#: After so many rows an item's trail is written into one string.
TRAIL_ROWS = 4096


class Grammar:
    """Dotted rules of a right-linear grammar, each with the terminal behind its dot and the items that reading it gives."""

    def __init__(self, rules: dict[str, list[tuple[str, ...]]], start: str):
        if any(x in rules for bodies in rules.values() for body in bodies for x in body[:-1]):
            raise ValueError("a nonterminal may only stand at the end of its rule")
        self.rules = rules
        self.first = self.predicted([(start, r, 0) for r in range(len(rules[start]))])
        self.symbol: dict[tuple, str] = {DONE: ""}
        self.after: dict[tuple, tuple] = {DONE: ()}
        for head, bodies in rules.items():
            for r, body in enumerate(bodies):
                for dot, x in enumerate(body):
                    if x not in rules:
                        self.symbol[head, r, dot] = x
                        self.after[head, r, dot] = self.predicted([(head, r, dot + 1)])

    def predicted(self, items: list[tuple]) -> tuple:
        """The items that read a terminal, reached by prediction and completion."""
        out: dict[tuple, None] = {}
        seen, todo = set(items), list(items)
        while todo:
            head, r, dot = todo.pop()
            body = self.rules[head][r]
            if dot == len(body):
                out[DONE] = None
            elif body[dot] not in self.rules:
                out[head, r, dot] = None
            else:
                more = {(body[dot], k, 0) for k in range(len(self.rules[body[dot]]))} - seen
                seen |= more
                todo += more
        return tuple(out)


#: s?(ua)+ or nothing.
CHAT = Grammar({"S": [(), ("T",), ("s", "T")], "T": [("u", "a"), ("u", "a", "T")]}, "S")


class Chart:
    """The current column of one conversation's chart.

    An item's state is (cost, rank, trail, digest). Audits of a column end with an edit of the same row, so none begins
    another one and their ranks decide every later comparison.
    """

    def __init__(self, grammar: Grammar = CHAT):
        self.grammar = grammar
        self.column = {item: (0, 0, None, None) for item in grammar.first}
        self.written: set[int] = set()
        self.rows = 0

    def opened(self) -> dict[tuple, tuple]:
        """The column's items and those that insertions reach: cost, rank, further audit, further lines, item it comes from."""
        symbol, after = self.grammar.symbol, self.grammar.after
        found = {i: (state[0], state[1], "", (), i) for i, state in self.column.items()}
        todo = list(found)
        while todo:
            i = todo.pop()
            if role := ROLES.get(symbol[i]):
                cost, rank, audit, lines, origin = found[i]
                new = (cost + INSERT, rank, audit + "I", (*lines, f"{role}:"), origin)
                for j in after[i]:
                    if j not in found or new < found[j]:
                        found[j] = new
                        todo.append(j)
        return found

    def read(self, role: str, text: str, truncated: bool, must_go: bool) -> None:
        """The next row: kept, given another role or deleted."""
        symbol, after = self.grammar.symbol, self.grammar.after
        initial, late = role[:1], TRUNCATED * truncated
        found: dict[tuple, tuple] = {}
        for i, (cost, rank, audit, lines, origin) in self.opened().items():
            new = (cost + DELETE, rank, audit + "D", lines, origin)
            if i not in found or new < found[i]:
                found[i] = new
            if must_go or i == DONE:
                continue
            edits = [(KEEP, "K", role)] if symbol[i] == initial else []
            if symbol[i] in ROLES:
                edits.append((REROLE, "R", ROLES[symbol[i]]))
            for price, edit, as_role in edits:
                new = (cost + price + late, rank, audit + edit, (*lines, f"{as_role}:{text}"), origin)
                for j in after[i]:
                    if j not in found or new < found[j]:
                        found[j] = new
        place = {key: n for n, key in enumerate(sorted({x[1:3] for x in found.values()}))}
        known: dict[tuple, object] = {}
        column = {}
        for i, (cost, rank, audit, lines, origin) in found.items():
            _, _, trail, digest = self.column[origin]
            if (rank, audit) not in known:
                known[rank, audit] = ((trail, audit), self.extended(digest, lines))
            column[i] = (cost, place[rank, audit], *known[rank, audit])
        self.column = column
        self.rows += 1
        if self.rows % TRAIL_ROWS == 0:
            self.write_trails()

    @staticmethod
    def extended(digest, lines: tuple[str, ...]):
        if not lines:
            return digest
        text = "\n".join(lines)
        if digest is None:
            return hashlib.sha256(text.encode())
        digest = digest.copy()
        digest.update(f"\n{text}".encode())
        return digest

    def written_out(self, trail) -> tuple:
        """The trail as its last written part and a string."""
        parts = []
        while trail is not None and id(trail) not in self.written:
            trail, audit = trail
            parts.append(audit)
        return trail, "".join(reversed(parts))

    def write_trails(self) -> None:
        """Put what each item's trail has gained into one string; what items share stays shared."""
        new: dict[int, tuple] = {}
        for _, _, trail, _ in self.column.values():
            if id(trail) not in new:
                new[id(trail)] = self.written_out(trail)
        self.column = {i: (c, r, new[id(t)], d) for i, (c, r, t, d) in self.column.items()}
        keep = set()
        for trail in new.values():
            while trail is not None and id(trail) not in keep:
                keep.add(id(trail))
                trail = trail[0]
        self.written = keep

    def repaired(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest edits that complete the chart; of equal ones the least audit."""
        cost, _, audit, lines, origin = self.opened()[DONE]
        _, _, trail, digest = self.column[origin]
        parts = [audit]
        while trail is not None:
            trail, audit = trail
            parts.append(audit)
        digest = self.extended(digest, lines)
        return cost, "".join(reversed(parts)), (digest or hashlib.sha256()).hexdigest()


class Conversation:
    """Counts and chart of one conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.chart = conv_id, Chart()
        self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def read(self, turn, role: str, text: str, copies: int, blank: bool, truncated: bool, seen: bool) -> None:
        """A row and its adjacent copies; seen: role and text stand in an earlier turn."""
        row = (turn, role, text)
        if copies and turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        for _ in range(copies):
            seen = seen or row == self.before
            if self.before is not None:
                self.illegal += self.before[1][:1] + role[:1] not in LEGAL
            again, cut = seen and not blank, truncated and not seen and not blank
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
            self.chart.read(role, text, cut, blank or again)
            self.before = row

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, digest = self.chart.repaired()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the damage that crc32 of conv_id:turn names; nulls of text, role and of the key are one space. copies: how often a row stands now, 0 if it is gone."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind < 2, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(shown("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def measured(rows: DataFrame) -> DataFrame:
    """Add blank and truncated by a row's own text."""
    end: Column = F.rtrim(F.col("text"), F.lit(SPACE))
    return rows.withColumns({"blank": end == "", "truncated": (end != "") & ~F.right(end, F.lit(1)).isin(".", "!", "?")})


def marked(rows: DataFrame) -> DataFrame:
    """Add seen: whether the same role and text stand in an earlier turn of the conversation.

    Equal rows are counted before they move, so that a text repeated any number of times leaves one row a task. Only
    texts of several rows come back, by broadcast if they are few, else by a join whose skew Spark can split. Rows of
    equal turn, role and text stand side by side later and are told there.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumns({"_digest": F.sha2("text", 256), "_place": place})
    first = rows.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "_digest").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    first = stored(first.where("_n > 1").drop("_n").withColumnsRenamed({"conv_id": "_c", "role": "_r", "_digest": "_d"}), "repeated")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    return rows.join(first, same, "left").withColumn("seen", F.coalesce(F.col("_place") > F.col("_first"), F.lit(False)))


def repair(conversations: DataFrame) -> DataFrame:
    """Damage conversations as named above and repair them.

    Returns one row per conv_id of the input, a null one too: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256. Null texts and roles are one space, so a null text is blank and a null role, like
    an empty one, can't be kept. Rows of equal turn stand by role, then text; rows repeated as a whole are duplicates of the first. A
    conversation that lost all its rows has zeros, an empty audit and the digest of the empty string. An empty table
    gives an empty table; further columns are ignored.

    All turns of a conversation pass one task, since the digest of its text is one sequential hash; they pass in
    order, sorted on disk if need be, and none is held.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    names = ["conv_id", "turn", "role", "text", "copies", "blank", "truncated", "seen"]
    rows = marked(measured(damaged(conversations))).select(*names)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, made, id_type = None, [], pa.null()

        def taken() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], out)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv_id, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if one is None or one.conv_id != conv_id:
                    if one is not None:
                        made.append(one.row())
                    one = Conversation(conv_id)
                one.read(*row)
            if len(made) > 2000:
                yield taken()
        if one is not None:
            made.append(one.row())
        if made:
            yield taken()

    return rows.mapInArrow(released(run), f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def oracle() -> str:
    """DuckDB SQL with the same rows: crc32 from its table, and the cheapest edits row by row over the states of the role pattern."""
    space = "e' \\t\\n\\x0b\\x0c\\r'"
    return f"""
WITH RECURSIVE
{crc32_tables("SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') FROM conversations")},
kind AS (SELECT key, c % 20 AS d FROM crc32),
damaged AS (
    SELECT conv_id, turn, d, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy,
           CASE d WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE d WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
    FROM conversations JOIN kind ON key = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')),
placed AS (
    SELECT *, rtrim(text, {space}) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
    FROM damaged),
faults AS MATERIALIZED (
    SELECT conv_id, turn, role, text, n, before, shown = '' AS blank, shown <> '' AND nth > 1 AS again,
           shown <> '' AND nth = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS cut
    FROM placed),
ins(a, b, cost, audit, lines) AS (
    VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
           ('0', 'u', 2, 'I', chr(10) || 'user:'), ('s', 'u', 2, 'I', chr(10) || 'user:'), ('a', 'u', 2, 'I', chr(10) || 'user:'), ('u', 'a', 2, 'I', chr(10) || 'assistant:'),
           ('0', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
           ('a', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:')),
step(a, b) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
edits AS (
    SELECT a, b, 'K' AS edit, b AS initial, NULL AS role, 0 AS cost FROM step
    UNION ALL SELECT a, b, 'R', NULL, CASE b WHEN 'u' THEN 'user' ELSE 'assistant' END, 2 FROM step WHERE b <> 's'
    UNION ALL SELECT DISTINCT a, a, 'D', NULL, NULL, 3 FROM ins),
ids AS (SELECT DISTINCT conv_id FROM conversations),
chart(conv_id, n, state, cost, audit, lines) AS (
    SELECT conv_id, 0::BIGINT, '0', 0, '', '' FROM ids
    UNION ALL
    SELECT c.conv_id, f.n, e.b, c.cost + i.cost + e.cost + CASE WHEN f.cut AND e.edit <> 'D' THEN 1 ELSE 0 END, c.audit || i.audit || e.edit,
           c.lines || i.lines || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, f.role) || ':' || f.text END
    FROM chart c JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.n = c.n + 1
    JOIN ins i ON i.a = c.state JOIN edits e ON e.a = i.b
    WHERE (e.edit = 'D' OR NOT (f.blank OR f.again)) AND (e.edit <> 'K' OR e.initial = left(f.role, 1))
    QUALIFY row_number() OVER (PARTITION BY c.conv_id, e.b ORDER BY c.cost + i.cost + e.cost + CASE WHEN f.cut AND e.edit <> 'D' THEN 1 ELSE 0 END, c.audit || i.audit || e.edit) = 1),
counts AS (
    SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
           count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
ends AS (
    SELECT c.conv_id, c.cost + i.cost AS cost, c.audit || i.audit AS audit, c.lines || i.lines AS lines
    FROM chart c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id JOIN ins i ON i.a = c.state AND i.b IN ('0', 'a')
    WHERE c.n = coalesce(k.rows, 0)
    QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.cost + i.cost, c.audit || i.audit) = 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost::BIGINT AS cost, audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id"""
