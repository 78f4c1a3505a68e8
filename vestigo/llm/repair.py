"""Conversation structure repair by an integer-minimum shortest path over weights of one number each.

A weight holds the cost in its high digits and, below them, the audit letters at fixed positions
from the left with zeros behind the last one, so the smaller number is the cheaper path and, of
equal costs, the one whose letters come first in ASCII; nothing else is compared. Rows are layers
of a DAG whose nodes are the last role reached (none, system, user, assistant), after the row; a
step is an edit of the row with at most one insertion in front of it.

So that numbers stay short however long a conversation is, letters are written out in blocks of
rows: at a block's end the paths into its nodes keep their cost, and one digit for their order, as
no path's letters can begin another's (each has edited as many rows, and ends with a row's letter).
A conversation is read in order by one task that holds a number and a running digest per node,
never its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Costs of edits and the damage rule.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
DAMAGE_MODULUS, DROPPED, EMPTIED, UNSTOPPED, REPEATED, REROLED = 20, 0, 1, 2, 3, 4
#: Edit letters as digits that keep their ASCII order; 0 stands behind the last letter.
DIGIT_BITS = 3
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = " DIKR"
#: Rows a number's letters cover; each has two letters at most, the end of a conversation two more.
BLOCK_ROWS = 32
WIDTH = 2 * BLOCK_ROWS + 2
#: Digits above the letters: two bits for the order of what lies before the block, then the cost.
ORDER_SHIFT = DIGIT_BITS * WIDTH
COST_SHIFT = ORDER_SHIFT + 2

# Nodes: the last role of the repaired conversation so far. A user may follow all but a user.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FOLLOWS = {SYSTEM: (NONE,), USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ENDS = (NONE, ASSISTANT)
LEGAL_PAIRS = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")

_LONG_MAX = 2**63 - 1


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage rule, with the columns `dropped`, `copy` (1 for a repetition) and
    `was_role`, `was_text` (role and text before it, which order rows of one turn). Null roles and
    texts read as one space. Dropped rows stay, marked, so that their conversation is not lost."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    lot = F.crc32(key) % DAMAGE_MODULUS
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("was_role"), F.coalesce("text", space).alias("was_text"), lot.alias("lot")
    )
    copies = F.when(F.col("lot") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("lot") == EMPTIED, "").when(F.col("lot") == UNSTOPPED, F.translate("was_text", ".!?", "")).otherwise(F.col("was_text"))
    return rows.select(
        "conv_id",
        "turn",
        "was_role",
        "was_text",
        F.explode(copies).alias("copy"),
        F.when(F.col("lot") == REROLED, "user").otherwise(F.col("was_role")).alias("role"),
        text.alias("text"),
        (F.col("lot") == DROPPED).alias("dropped"),
    )


_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
_WHOLE = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


class Conversation:
    """One conversation, fed row by row in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = 0
        self.before: str | None = None
        self.lowest = self.highest = self.last_turn = None
        self.turns = 0
        # node -> (weight, letters in the block, node at the block's start, digest)
        self.paths: dict[int, tuple[int, int, int, Any]] = {NONE: (0, 0, NONE, None)}
        self.rows = 0
        self.blocks: list[dict[int, tuple[int, str]]] = []

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.lowest = turn if self.lowest is None else self.lowest
            self.turns += self.highest is None or turn != self.highest
            self.highest = turn
        if self.before is not None and self.before + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = role[:1]
        fault = "blank" if _BLANK.match(text) else "duplicate" if seen else None if _WHOLE.search(text) else "truncated"
        if fault:
            self.counts[fault] += 1
        self._step(role, text, deletable_only=fault in ("blank", "duplicate"), extra=TRUNCATED_COST if fault == "truncated" else 0)

    @staticmethod
    def _longer(weight: int, used: int, letter: str, cost: int) -> int:
        return weight + (cost << COST_SHIFT) + (DIGITS[letter] << (ORDER_SHIFT - DIGIT_BITS * (used + 1)))

    def _step(self, role: str, text: str, deletable_only: bool, extra: int) -> None:
        """One layer: of all edits that reach a node, the one of the smallest weight."""
        found: dict[int, tuple] = {}

        def offer(node: int, weight: int, used: int, start: int, lines: tuple, digest: Any) -> None:
            if node not in found or weight < found[node][0]:
                found[node] = (weight, used, start, lines, digest)

        kept = INITIALS.get(role[:1])
        edits = [] if deletable_only else [("R", USER, "user"), ("R", ASSISTANT, "assistant")]
        if kept is not None and not deletable_only:
            edits.append(("K", kept, role))
        for node, (weight, used, start, digest) in self.paths.items():
            sources = [(node, weight, used, ())]
            for name in (USER, ASSISTANT):
                if node in FOLLOWS[name]:
                    sources.append((name, self._longer(weight, used, "I", INSERT_COST), used + 1, (NAMES[name], ":")))
            for at, so_far, letters, lines in sources:
                offer(at, self._longer(so_far, letters, "D", DELETE_COST), letters + 1, start, lines, digest)
                for letter, reached, name in edits:
                    if at in FOLLOWS[reached]:
                        cost = extra + (REROLE_COST if letter == "R" else 0)
                        offer(reached, self._longer(so_far, letters, letter, cost), letters + 1, start, lines + (name, ":" + text), digest)
        self.paths = {node: (w, used, start, self._written(digest, lines)) for node, (w, used, start, lines, digest) in found.items()}
        self.rows += 1
        if self.rows % BLOCK_ROWS == 0:
            self._close_block()

    @staticmethod
    def _written(digest: Any, lines: tuple) -> Any:
        """The digest with (role, ":text", ...) appended, lines parted by a line end; None before the first."""
        if not lines:
            return digest
        out = hashlib.sha256() if digest is None else digest.copy()
        for i in range(0, len(lines), 2):
            head = lines[i] if digest is None and i == 0 else "\n" + lines[i]
            out.update((head + lines[i + 1]).encode())
        return out

    @staticmethod
    def _letters(weight: int, used: int) -> str:
        low = weight >> (ORDER_SHIFT - DIGIT_BITS * used)
        return "".join(LETTERS[(low >> DIGIT_BITS * k) & 7] for k in range(used - 1, -1, -1))

    def _close_block(self) -> None:
        """Writes the letters out; the order of the paths so far becomes the digit above the next ones."""
        mask = (1 << COST_SHIFT) - 1
        self.blocks.append({node: (start, self._letters(w, used)) for node, (w, used, start, _) in self.paths.items()})
        order = sorted(self.paths, key=lambda node: self.paths[node][0] & mask)
        self.paths = {
            node: (((w >> COST_SHIFT) << COST_SHIFT) | (order.index(node) << ORDER_SHIFT), 0, node, digest)
            for node, (w, _, _, digest) in self.paths.items()
        }

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = []
        for node, (weight, used, start, digest) in self.paths.items():
            if node in ENDS:
                ends.append((weight, used, start, digest, ()))
            if node == USER:
                ends.append((self._longer(weight, used, "I", INSERT_COST), used + 1, start, digest, ("assistant", ":")))
            if node == SYSTEM:
                once = self._longer(weight, used, "I", INSERT_COST)
                ends.append((self._longer(once, used + 1, "I", INSERT_COST), used + 2, start, digest, ("user", ":", "assistant", ":")))
        weight, used, node, digest, lines = min(ends, key=lambda e: e[0])
        audit = [self._letters(weight, used)]
        for block in reversed(self.blocks):
            node, letters = block[node]
            audit.append(letters)
        digest = self._written(digest, lines)
        gaps = 0 if self.lowest is None else min(self.highest - self.lowest + 1 - self.turns, _LONG_MAX)
        return (
            gaps,
            *(self.counts[f] for f in FAULTS),
            self.illegal,
            weight >> COST_SHIFT,
            "".join(reversed(audit)),
            (hashlib.sha256() if digest is None else digest).hexdigest(),
        )


_RESULT = [(c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Results leave a task in batches of so many conversations or, as audits may be long, characters of them.
BATCH_RESULTS, BATCH_CHARS = 2000, 1 << 22


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and place to one row per conversation."""
    current: Any = None
    talk: Conversation | None = None
    done: list[tuple] = []
    chars = 0
    schema: pa.Schema | None = None

    def flush() -> pa.RecordBatch:
        nonlocal chars
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        done.clear()
        chars = 0
        return out

    def finish() -> None:
        nonlocal chars
        row = (current, *talk.result())
        chars += len(row[7])
        done.append(row)

    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_RESULT])
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "dropped")]
        for conv, turn, role, text, seen, dropped in zip(*columns):
            if talk is None or conv != current:
                if talk is not None:
                    finish()
                    if len(done) >= BATCH_RESULTS or chars >= BATCH_CHARS:
                        yield flush()
                current, talk = conv, Conversation()
            if not dropped:
                talk.add(turn, role, text, seen)
    if talk is not None:
        finish()
    if done:
        yield flush()


def repaired(rows: DataFrame) -> DataFrame:
    """Cheapest repair of each conversation of `damaged` rows: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role, text, repetition. One shuffle by conversation
    serves both the search for earlier rows of the same role and text and the ordered reading; both
    sort and spill. The digest of a conversation's text runs from its first row to its last, so a
    conversation is one sequential piece of work, in constant memory but for its audit.
    Null conv_ids form one conversation. A role without a first letter can't be kept. Roles count by
    their first letter, case included. `gaps` stops at the largest long.
    """
    place = ["turn", "was_role", "was_text", "copy"]
    told = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(*place)
    marked = told.withColumn("seen", F.row_number().over(same) > 1)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT_DDL}"
    ordered = marked.sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in place])
    return ordered.select("conv_id", "turn", "role", "text", "seen", "dropped").mapInArrow(_fold, schema)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages conversations by the fixed rule and repairs them; one row per original conv_id, those
    without rows after the damage included (zeros, no letters, digest of nothing). Only the columns
    conv_id, turn, role and text are read; an empty table gives no rows."""
    return repaired(damaged(conversations))
