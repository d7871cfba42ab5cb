"""Conversations as training texts: windows of whole turns within a budget of tokens, and a mask of what is learned."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable

OPEN, ROLE_END, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
# Strings that mean something to the template or to chat models; inside texts they get a backslash after the first character.
_CONTROL = re.compile(r"(?:<(?=\\*/?s>)|\[(?=\\*/?(?:ROLE|INST|SYS)\]))")
_ESCAPED = re.compile(r"(?:(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?(?:ROLE|INST|SYS)\]))")

BLOCK_BITS = 6
NO_TURN = -(1 << 62)
# Rows that a task looks at together, whatever the conversation has.
RUN = 256
# Rows of a block, in this order.
HEAD, SYSTEM, CARRIED, OWN = range(4)
# Characters of a conversation that are handed on at once.
PIECE = 1 << 16

WINDOWS = (
    "conv_id {id}, block BIGINT, blocks BIGINT, window INT, n_turns INT, n_tokens BIGINT, over_budget BOOLEAN, "
    "text STRING, repeated INT, loss array<struct<start: int, end: int>>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def written(role: str, text: str) -> str:
    """One turn in the template. No control string of it can come from the role or the text."""
    return f"{OPEN}{escape(role)}{ROLE_END}{escape(text)}{CLOSE}"


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a formatted text, as they were."""
    turns = []
    for piece in text.split(CLOSE)[:-1]:
        role, said = piece.removeprefix(OPEN).split(ROLE_END, 1)
        turns.append((unescape(role), unescape(said)))
    return turns


@lru_cache(maxsize=2)
def _library(path: str):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def token_lengths(texts: list[str], path: str) -> list[int]:
    return [len(found.ids) for found in _library(path).encode_batch(texts, add_special_tokens=False)]


def spans(tokens: list[int], fresh: int, system: int, budget: int, history: int, oldest: list[int]) -> list[tuple[int, int, int]]:
    """``(history start, start, end)`` of windows over the turns from ``fresh`` on, by prefix sums of their tokens.

    A window has the system turn, some turns before its own, and its own, within the budget; its own turns
    are as many as fit and at least one. The turns before are those from ``oldest[start]`` on, without the first ones
    as long as they have more than ``history`` tokens or leave no room for one turn. Every turn is in one window's own.
    """
    sums = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    found, start = [], fresh
    while start < len(tokens):
        most = min(history, budget - system - int(tokens[start]))
        back = max(oldest[start], int(np.searchsorted(sums, sums[start] - most))) if most > 0 else start
        end = int(np.searchsorted(sums, sums[back] + budget - system, side="right")) - 1
        end = min(max(end, start + 1), len(tokens))
        found.append((min(back, start), start, end))
        start = end
    return found


@dataclass
class _Turn:
    number: int | None
    shown: str
    tokens: int
    target: tuple[int, int] | None

    @staticmethod
    def of(number: int | None, role: str, shown: str, tokens: int) -> _Turn:
        inside = (shown.index(ROLE_END) + len(ROLE_END), len(shown) - len(CLOSE))
        return _Turn(number, shown, tokens, inside if role == "assistant" else None)


class _Block:
    """The windows of one block, as its rows come by: at most RUN of its own turns and as many before them are held."""

    def __init__(self, at: tuple, blocks: int, begins_with_system: bool, budget: int, history: int, back: int):
        self.at, self.blocks, self.budget, self.history, self.back = at, blocks, budget, history, back
        self.begins_with_system = begins_with_system
        self.system: _Turn | None = None
        # The system turn of the first block is an own turn of the first window, and context everywhere else.
        self.system_due = False
        self.before: list[_Turn] = []
        self.run: list[_Turn] = []
        self.windows = 0

    def add(self, kind: int, turn: _Turn) -> list[tuple]:
        if kind == SYSTEM:
            self.system = turn
        elif kind == CARRIED:
            self.before = [*self.before, turn][-RUN:]
        elif self.begins_with_system and self.system is None:
            self.system, self.system_due = turn, True
        else:
            self.run.append(turn)
        return self.flush() if len(self.run) == RUN else []

    def flush(self) -> list[tuple]:
        held, low, oldest = [*self.before, *self.run], 0, []
        for turn in held:
            while turn.number is not None and (held[low].number is None or held[low].number < turn.number - self.back):
                low += 1
            oldest.append(low)
        system = self.system.tokens if self.system else 0
        chosen = spans([t.tokens for t in held], len(self.before), system, self.budget, self.history, oldest)
        made = [self._window(held[start:own], held[own:end]) for start, own, end in chosen]
        self.before, self.run = held[-RUN:], []
        return made

    def end(self) -> list[tuple]:
        made = self.flush()
        return [*made, self._window([], [])] if self.system_due else made

    def _window(self, repeated: list[_Turn], own: list[_Turn]) -> tuple:
        """One window: its text, how much of it is repeated, and where the texts to learn stand."""
        system = [self.system] if self.system else []
        if self.system_due:
            context, own, self.system_due = repeated, [*system, *own], False
        else:
            context = [*system, *repeated]
        skipped = sum(len(t.shown) for t in context)
        at, loss = skipped, []
        for turn in own:
            if turn.target:
                loss.append({"start": at + turn.target[0], "end": at + turn.target[1]})
            at += len(turn.shown)
        text, tokens = "".join(t.shown for t in [*context, *own]), sum(t.tokens for t in [*context, *own])
        self.windows += 1
        return (*self.at, self.blocks, self.windows - 1, len(own), tokens, tokens > self.budget, text, skipped, loss)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _blocks(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, back: int) -> DataFrame:
    """Rows by block of a conversation: its head, its system turn, turns that may be repeated, and its own.

    ``kind``: 0 a head with the number of blocks, 1 the system turn, 2 turns of the block before, 3 own turns. A
    block has the turns of 64 turn numbers. Only heads and counts go through a shuffle of their own.
    """
    # Rows without a turn number come first, in a block of their own.
    block = F.coalesce(F.shiftright(F.col(turn_col).cast("long"), BLOCK_BITS), F.lit(NO_TURN >> BLOCK_BITS))
    rows = conversations.select(
        F.col(id_col).alias("conv_id"),
        block.alias("block"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    first_row = F.min(F.struct(F.coalesce("turn", F.lit(NO_TURN)).alias("turn"), "role")).alias("first")
    counted = durable(rows.groupBy("conv_id", "block").agg(first_row))
    conversation = counted.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.min("block").alias("first_block"), F.min("first").alias("first")
    )
    # A system turn is the first turn of a conversation.
    headed = conversation.select(
        F.col("conv_id").alias("of"), "blocks", "first_block", (F.col("first.role") == "system").alias("has_system")
    )
    heads = durable(
        counted.select("conv_id", "block")
        .join(headed, F.col("conv_id").eqNullSafe(F.col("of")))
        .select("conv_id", "block", "blocks", (F.col("block") == F.col("first_block")).alias("is_first"), "has_system")
    )
    shared = [F.lit(0).cast("long").alias("blocks"), F.lit(False).alias("begins_with_system")]
    shown = ["conv_id", "block", "kind", "turn", "role", "text"]
    own = rows.withColumn("kind", F.lit(OWN))
    # The last turn numbers of a block may be repeated at the beginning of the next.
    last = (1 << BLOCK_BITS) - back
    carried = rows.where(F.col("turn").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) >= last).withColumns(
        {"kind": F.lit(CARRIED), "block": F.col("block") + 1}
    )
    # A conversation of several blocks has its system turn in each. Of several rows at its start, the smallest text is it.
    several = (F.col("blocks") > 1) & (F.col("first.role") == "system")
    start = conversation.where(several).select(F.col("conv_id").alias("of"), F.col("first.turn").alias("start"))
    at_start = F.col("conv_id").eqNullSafe(F.col("of")) & (F.coalesce("turn", F.lit(NO_TURN)) == F.col("start"))
    systems = (
        rows.where("role = 'system'")
        .join(start, at_start)
        .groupBy(F.col("conv_id").alias("of"))
        .agg(F.min("text").alias("text"), F.min("turn").alias("turn"))
    )
    retained = (
        heads.where("not is_first")
        .select("conv_id", "block")
        .join(systems, F.col("conv_id").eqNullSafe(F.col("of")))
        .withColumns({"kind": F.lit(SYSTEM), "role": F.lit("system")})
    )
    head = heads.select(
        "conv_id", "block", F.lit(HEAD).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("text"), "blocks", (F.col("is_first") & F.col("has_system")).alias("begins_with_system"),
    )
    for part in (retained, carried, own):
        head = head.unionByName(part.select(*shown, *shared))
    return head


def format_conversations(
    conversations: DataFrame,
    tokenizer: str,
    budget: int = 2048,
    history: int = 512,
    back: int = 8,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, block, blocks, window, n_turns, n_tokens, over_budget, text, repeated, loss``: training texts.

    Turns are shown whole in a template. Windows have the conversation's system turn (its first turn, if of that
    role), then at most ``history`` tokens of the turns before, of at most ``back`` turn numbers, then their own: as many as fit the ``budget``. Each turn is one
    window's own. ``repeated`` is the number of characters at the beginning that are there for context only;
    ``loss`` has the texts of the own turns of assistants, as places of characters. A turn that is too long is a window of its own,
    whole, ``over_budget``; nothing is cut.

    Turns go by number (none first), role and text; NULL roles and texts are empty; rows without an
    id are one conversation; repeated rows are turns that repeat. ``tokenizer`` is the path of a
    vocabulary file on every machine.

    Texts are shuffled once, by conversation and 64 turn numbers, so a long conversation is spread; windows begin
    anew with each such block. A task holds 256 turns at most beside the batch it reads. Rows of one conversation
    that share 64 turn numbers, however many, are read by one task.
    """
    if not 0 <= back <= 1 << BLOCK_BITS:
        raise ValueError("turns are repeated from the block before at most")
    kind = conversations.schema[id_col].dataType.simpleString()
    rows = _blocks(conversations, id_col, turn_col, role_col, text_col, back)
    names = ["conv_id", "block", "blocks", "window", "n_turns", "n_tokens", "over_budget", "text", "repeated", "loss"]
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.list_(place)]

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of_id = None, pa.null()
        for batch in batches:
            of_id, made, columns = batch.schema.field("conv_id").type, [], batch.to_pydict()
            kinds, roles = columns["kind"], columns["role"]
            shown = [written(r, t) if k else "" for k, r, t in zip(kinds, roles, columns["text"], strict=True)]
            lengths = token_lengths(shown, tokenizer)
            for i, at in enumerate(zip(columns["conv_id"], columns["block"], strict=True)):
                if kinds[i] == HEAD:
                    made += block.end() if block else []
                    block = _Block(at, columns["blocks"][i], columns["begins_with_system"][i], budget, history, back)
                elif block is not None and block.at == at:
                    made += block.add(kinds[i], _Turn.of(columns["turn"][i], roles[i], shown[i], lengths[i]))
                # What is left was carried to a block that its conversation does not have.
            if made:
                yield _table(made, names, [of_id, *types])
        if made := block.end() if block else []:
            yield _table(made, names, [of_id, *types])

    order = ["conv_id", "block", "kind", F.asc_nulls_first("turn"), "role", "text"]
    placed = rows.repartition("conv_id", "block").sortWithinPartitions(*order)
    return placed.mapInArrow(windows, WINDOWS.format(id=kind))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from formatted windows.

    ``turns_sha256`` is of role, line feed, text, line feed of all turns that are a window's own; ``loss_sha256`` of the
    texts under the loss mask, ``loss_chars`` their characters; ``formatted_chars`` counts all of all windows.
    The windows must come as :func:`format_conversations` hands them out. Conversations of one block are
    settled where they are; the others' texts are shuffled by conversation and hashed as they come by, a row at a time.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "block", "piece", "done", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    counts = ("n_turns", "loss_chars", "formatted_chars")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_id = None, pa.null()

        def close(held: dict) -> tuple:
            turns, loss = held["turns"], held["loss"]
            shown = (turns.hexdigest(), loss.hexdigest()) if held["done"] else ("".join(turns), "".join(loss))
            return (*held["at"], held["piece"], held["done"], *[held[c] for c in counts], *shown)

        def begin(at: tuple, done: bool, piece: int = 0) -> dict:
            empty = hashlib.sha256 if done else list
            return {"at": at, "done": done, "piece": piece, **dict.fromkeys(counts, 0), "turns": empty(), "loss": empty()}

        for batch in batches:
            of_id, made, columns = batch.schema.field("conv_id").type, [], batch.to_pydict()
            for i, at in enumerate(zip(columns["conv_id"], columns["block"], strict=True)):
                if held is None or held["at"] != at:
                    made += [close(held)] if held else []
                    held = begin(at, columns["blocks"][i] == 1)
                elif not held["done"] and held["formatted_chars"] >= PIECE:
                    made.append(close(held))
                    held = begin(at, False, held["piece"] + 1)
                text = columns["text"][i]
                turns = read_turns(text[columns["repeated"][i] :])
                learned = [unescape(text[span["start"] : span["end"]]) for span in columns["loss"][i]]
                held["n_turns"] += len(turns)
                held["loss_chars"] += sum(map(len, learned))
                held["formatted_chars"] += len(text)
                for name, said in (("turns", "".join(f"{r}\n{t}\n" for r, t in turns)), ("loss", "".join(learned))):
                    held[name].update(said.encode()) if held["done"] else held[name].append(said)
            if made:
                yield _table(made, names, [of_id, *types])
        if held:
            yield _table([close(held)], names, [of_id, *types])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_id = None, pa.null()
        close = lambda h: (h["id"], *[h[c] for c in counts], h["turns"].hexdigest(), h["loss"].hexdigest())
        table = lambda rows: _table(rows, ["conv_id", *counts, "turns", "loss"], [of_id, *types[3:]])
        for batch in batches:
            of_id, made, columns = batch.schema.field("conv_id").type, [], batch.to_pydict()
            for i, conv_id in enumerate(columns["conv_id"]):
                if held is None or held["id"] != conv_id:
                    made += [close(held)] if held else []
                    held = {"id": conv_id, **dict.fromkeys(counts, 0), "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for name in counts:
                    held[name] += columns[name][i]
                for name in ("turns", "loss"):
                    held[name].update(columns[name][i].encode())
            if made:
                yield table(made)
        if held:
            yield table([close(held)])

    summed = "n_turns BIGINT, loss_chars BIGINT, formatted_chars BIGINT, turns STRING, loss STRING"
    pieces = durable(windows.mapInArrow(read, f"conv_id {kind}, block BIGINT, piece INT, done BOOLEAN, {summed}"))
    rest = pieces.where("not done").repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")
    whole = pieces.where("done").select("conv_id", *counts, "turns", "loss")
    return whole.unionByName(rest.mapInArrow(joined, f"conv_id {kind}, {summed}")).select(
        "conv_id", "n_turns", F.col("turns").alias("turns_sha256"), "loss_chars", F.col("loss").alias("loss_sha256"), "formatted_chars"
    )
