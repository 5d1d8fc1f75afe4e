"""Chat formatting in budgeted windows.

Turns of a conversation stream past in order, sorted by the shuffle, so that a conversation of any
length is formatted in bounded memory. Prefix sums of the turns' token counts choose spans that end
with whole turns: a window holds the system turn, a few repeated turns of history and as many new
turns as fit the budget. The loss mask covers the assistant's texts, and repeated ones not again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import parts_for, table

#: The template: <s>[INST]role[/INST]text</s> for every turn.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile("|".join(map(re.escape, (OPEN, ROLE, TEXT, CLOSE))) + r"|\\")
_ESCAPED = re.compile(r"\\([\\~])")
_TURN = re.compile(f"{re.escape(OPEN + ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(CLOSE)}", re.DOTALL)

#: Tokens of a window, of the history that it repeats, turns of that history at most, and tokens that a turn's marks count as.
BUDGET, HISTORY, HISTORY_TURNS, MARKS = 1024, 256, 2, 12


def escape(text: str) -> str:
    r"""``\`` doubles, and ``\~`` parts the first character of a control string from the rest."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\~" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends in it."""
    head, body = OPEN + ROLE + escape(role) + TEXT, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


class Windows:
    """The windows of one conversation, made as its turns come."""

    def __init__(self, budget: int, history: int, history_turns: int) -> None:
        self.budget, self.history, self.history_turns = budget, history, history_turns
        self.system: tuple[str, str, int] | None = None
        self.last: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str, int]] = []
        self.repeated = self.sum = self.count = self.seen = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens + MARKS)
        if len(self.turns) > self.repeated and self.sum + turn[2] > self.budget:
            yield self.close()
            self._begin(turn[2])
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        self.sum += turn[2]
        self.last = [*self.last, turn][-self.history_turns :] if self.history_turns else []

    def _begin(self, first: int) -> None:
        """Start a window with what it repeats, as far as that leaves room for the next turn."""
        again: list[tuple[str, str, int]] = []
        total = self.system[2] if self.system else 0
        room = min(self.history, self.budget - first - total)
        for turn in reversed([t for t in self.last if t is not self.system]):
            if sum(t[2] for t in again) + turn[2] > room:
                break
            again.insert(0, turn)
        self.turns = ([self.system] if self.system else []) + again
        self.repeated = len(self.turns)
        self.sum = sum(t[2] for t in self.turns)

    def close(self) -> tuple:
        """(window, first turn, repeated turns, tokens, text, starts and ends of the loss mask)."""
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate(self.turns):
            part, start, end = turn_text(role, text)
            if k >= self.repeated and role == "assistant":
                starts.append(at + start)
                ends.append(at + end)
            parts.append(part)
            at += len(part)
        row = (self.count, self.seen - len(self.turns) + self.repeated, self.repeated, self.sum, "".join(parts), starts, ends)
        self.count += 1
        return row


_SCHEMA = "conv_id long, window long, first_turn long, repeated int, tokens long, text string, loss_starts array<long>, loss_ends array<long>"


def _key(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Windows of all conversations: ``conv_id, window, first_turn, repeated, tokens, text, loss_starts, loss_ends``.

    Turns go by ``turn``, ties by role and text; null texts and roles count as empty; a null turn comes first; rows
    with a null conv_id are one conversation of their own. Repeated rows are turns of their own. The system
    turn is the first turn, if its role is ``system``. A turn that exceeds the budget stays whole and is a window alone
    (with the system turn). Spans count code points. An empty table gives no window; other columns are ignored.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield b.assign(tokens=[len(x) // 4 for x in enc.encode(b["text"].tolist())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, now = None, None
        for b in batches:
            out = []
            for conv, role, text, tokens in zip(b["conv_id"], b["role"], b["text"], b["tokens"], strict=True):
                if own is None or _key(conv) != now:
                    if own is not None:
                        out.append((now, *own.close()))
                    own, now = Windows(budget, history, history_turns), _key(conv)
                out.extend((now, *w) for w in own.add(role, text, tokens))
            yield _frame(out)
        if own is not None:
            yield _frame([(now, *own.close())])

    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    counted = rows.mapInPandas(count, "conv_id long, turn long, role string, text string, tokens long")
    dealt = counted.repartition(parts_for(conversations, 64 << 20), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(run, _SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "first_turn", "repeated", "tokens", "text", "loss_starts", "loss_ends"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """What windows hold, parsed from their texts: one row per conversation, see ``op10_chat``.

    ``in_order`` says that the windows come as ``format_windows`` gives them, so that they need no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done() -> tuple:
            return (now, own["turns"], own["all"].hexdigest(), own["loss"], own["masked"].hexdigest(), own["chars"])

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            out["conv_id"] = out["conv_id"].astype("Int64")
            return out

        for b in batches:
            out = []
            for conv, text, repeated, starts, ends in zip(b["conv_id"], b["text"], b["repeated"], b["loss_starts"], b["loss_ends"], strict=True):
                if own is None or _key(conv) != now:
                    if own is not None:
                        out.append(done())
                    now, own = _key(conv), {"turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                for k, turn in enumerate(_TURN.finditer(text)):
                    if k >= repeated:
                        own["turns"] += 1
                        own["all"].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                for start, end in zip(starts, ends, strict=True):
                    plain = unescape(text[start:end])
                    own["loss"] += len(plain)
                    own["masked"].update(plain.encode())
                own["chars"] += len(text)
            yield frame(out)
        if own is not None:
            yield frame([done()])

    rows = windows.select("conv_id", "window", "repeated", "text", "loss_starts", "loss_ends")
    if not in_order:
        rows = rows.repartition(parts_for(rows, 64 << 20), "conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(trap)
    return read_back(format_windows(rows, tokenizer), in_order=True)
