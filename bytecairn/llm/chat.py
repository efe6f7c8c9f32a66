r"""Chat formatting in budgeted windows.

A conversation's turns become windows of at most ``BUDGET`` tokens. Prefix sums of the turns' token counts choose
spans that begin and end at turns; a leading system turn is retained in every window; up to ``HISTORY`` tokens of the
turns before a window are repeated as context, and of repeated turns no assistant text is a target again.

Template: ``### Role: text </turn>`` and a line end per turn. In role and text a backslash goes before every backslash and before
the control strings ``###`` and ``</turn>`` (a role also escapes ``: ``), so unescaping gives back what was written.

Conversations are dealt by conv_id, sorted by turn and streamed: a task holds one window's turns, not a
conversation, so a conversation of any length passes.

Defined cases: a null text is empty; a null role is the empty role; rows go by turn, then role, then text (nulls first),
so repeated rows are repeated turns; a null conv_id is a conversation of its own; a turn that alone exceeds the
budget is a window of its own (with the system turn, without history) and is marked ``oversize``; a
further system turn is an ordinary turn; an empty table gives no windows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, materialise, table

BUDGET = 1024
HISTORY = 256
VOCABULARY = "byte_bpe_50k.json"
ENCODE_CHARS = 1 << 20
OPEN, CLOSE = "### ", " </turn>\n"
WINDOW = "conv_id long, window int, text string, n_turns int, n_repeated int, n_tokens int, oversize boolean, mask array<struct<start:int,end:int>>"

_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|: ")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|: )")
#: One formatted turn: escaped role, escaped text with the template's space, end. Possessive, so long texts need no backtracking.
_TURN = re.compile(
    r"### ((?:[^\\#<:]++|\\(?:\\|###|</turn>|: )|#(?!##)|<(?!/turn>)|:(?! ))*+): "
    r"((?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+)</turn>\n"
)


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def shown_role(role: str) -> str:
    """The role in a heading: capitalised where that can be undone, else behind an equals sign."""
    shown = role.capitalize()
    return shown if role and not role.startswith("=") and shown.lower() == role else "=" + role


def role_of(shown: str) -> str:
    return shown[1:] if shown.startswith("=") else shown.lower()


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the span of its escaped text."""
    head, body = f"{OPEN}{escape(shown_role(role), True)}: ", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window's text."""
    turns, at = [], 0
    while at < len(window):
        if not (m := _TURN.match(window, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((role_of(unescape(m[1])), unescape(m[2][:-1])))
        at = m.end()
    return turns


@dataclass
class Turn:
    role: str
    text: str
    start: int
    end: int
    tokens: int


@dataclass
class Windower:
    """Windows of one conversation as its turns arrive."""

    budget: int
    history: int
    system: Turn | None = None
    shown: bool = False
    context: list[Turn] = field(default_factory=list)
    fresh: list[Turn] = field(default_factory=list)
    started: bool = False
    number: int = 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        if not self.started and turn.role == "system":
            self.system, self.started = turn, True
            return
        self.started = True
        fixed = self.system.tokens if self.system else 0
        sums = [0, *accumulate(t.tokens for t in self.context + self.fresh)]
        if self.fresh and fixed + sums[-1] + turn.tokens > self.budget:
            turns = self.context + self.fresh
            yield self.window()
            room = max(0, min(self.history, self.budget - fixed - turn.tokens))
            self.context, self.fresh = turns[bisect_left(sums, sums[-1] - room) :], []
        self.fresh.append(turn)

    def close(self) -> Iterator[tuple]:
        if self.fresh or (self.system and not self.shown):
            yield self.window()

    def window(self) -> tuple:
        turns = ([self.system] if self.system else []) + self.context + self.fresh
        repeated = len(turns) - len(self.fresh) - (self.system is not None and not self.shown)
        at, mask = 0, []
        for k, t in enumerate(turns):
            if k >= repeated and t.role == "assistant":
                mask.append({"start": at + t.start, "end": at + t.end})
            at += len(t.text)
        tokens = sum(t.tokens for t in turns)
        self.shown, self.number = True, self.number + 1
        return self.number - 1, "".join(t.text for t in turns), len(turns), repeated, tokens, tokens > self.budget, mask


def _ids(column: pd.Series) -> list[int | None]:
    return [None if v is None else int(v) for v in column]


def token_counts(tokenizer: Tokenizer, texts: list[str]) -> list[int]:
    """Tokens of each text; some megabytes are encoded at a time, since encodings take many times their text's room."""
    counts, at = [], 0
    while at < len(texts):
        end, room = at, 0
        while end < len(texts) and (end == at or room + len(texts[end]) <= ENCODE_CHARS):
            room += len(texts[end])
            end += 1
        counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
        at = end
    return counts


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """Windows of every conversation, as in WINDOW; ``mask`` spans are code points of ``text``."""
    file = path or public_tokenizers.path(VOCABULARY)
    names = [c.split()[0] for c in WINDOW.replace("struct<start:int,end:int>", "").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer.from_file(file)
        tokenizer.encode_special_tokens = True
        current, windower = object(), None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["conv_id"] = out["conv_id"].astype("Int64")
            return out

        for pdf in batches:
            rows = []
            formatted = [format_turn(r or "", t or "") for r, t in zip(pdf["role"], pdf["text"])]
            counts = token_counts(tokenizer, [f[0] for f in formatted])
            for conv, role, (text, start, end), n in zip(_ids(pdf["conv_id"]), pdf["role"], formatted, counts):
                if windower is None or conv != current:
                    rows += [(current, *w) for w in windower.close()] if windower else []
                    current, windower = conv, Windower(budget, history)
                rows += [(conv, *w) for w in windower.add(Turn(role or "", text, start, end, n))]
            if rows:
                yield frame(rows)
        if windower and (rows := [(current, *w) for w in windower.close()]):
            yield frame(rows)

    keyed = conversations.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), "turn", "role", "text")
    dealt = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInPandas(run, WINDOW)


def read_conversations(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, digests of turns and loss text, loss and formatted lengths."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["conv_id"] = out["conv_id"].astype("Int64")
            return out

        def result() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for pdf in batches:
            rows = []
            for conv, text, repeated, mask in zip(_ids(pdf["conv_id"]), pdf["text"], pdf["n_repeated"], pdf["mask"]):
                if state is None or conv != current:
                    rows += [result()] if state else []
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_turns(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    part = unescape(text[span["start"] : span["end"]])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            if rows:
                yield frame(rows)
        if state:
            yield frame([result()])

    keyed = windows.select(F.col("conv_id").cast("string").alias("conv_id"), "window", "text", "n_repeated", "mask")
    dealt = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: What both turns of the added conversation say, control strings and a backslash included.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    with bounded_batches(spark):
        return materialise(read_conversations(format_conversations(rows.unionByName(added))))
