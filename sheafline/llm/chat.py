"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role's label and the pieces a turn is made of, each
with its loss flag. The machine walks a conversation's turns in order, says whether
each role may follow the one before, and emits the template's pieces as text segments.
Control strings inside texts are escaped, so that the formatted text reads back.

Conversations are sorted within partitions and streamed: memory holds one turn, so a
conversation of any length passes, though all its turns pass through one task.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import ship, small_batches

ship(__name__)


@dataclass(frozen=True)
class Template:
    """labels: what the header shows for a role; other roles are shown as ``@role``.

    pieces: (text, loss) by role, or under ``*`` for any other; ``{label}`` and
    ``{text}`` are put in. follows: roles that may follow a role, ``^`` is the start.
    """

    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    pieces: dict = field(default_factory=lambda: {
        "assistant": (("### {label}: ", False), ("{text}", True), (" </turn>\n", False)),
        "*": (("### {label}: ", False), ("{text}", False), (" </turn>\n", False)),
    })
    follows: dict = field(default_factory=lambda: {"^": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Escaped wherever they start in a text; a backslash marks the next character as plain.
    controls: tuple = ("###", "</turn>")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            # Every start, also of overlapping ones, gets a mark.
            text = re.sub(f"{re.escape(control[0])}(?={re.escape(control[1:])})", "\\\\" + control[0], text)
        return text

    def label(self, role: str) -> str:
        return self.labels.get(role) or "@" + re.sub(r"([\\:@<#])", r"\\\1", role)

    def segments(self, role: str, text: str):
        """(text, loss) pieces of a turn; pieces may be empty."""
        for piece, loss in self.pieces.get(role, self.pieces["*"]):
            yield piece.replace("{label}", self.label(role)) if "{text}" not in piece else piece.replace("{text}", self.escape(text)), loss


TEMPLATE = Template()


def plain(text: str) -> str:
    """The text without escapes."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: One turn of formatted text: its label, and its text up to the first end of turn that no backslash marks as plain.
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_turn(text: str, at: int = 0, template: Template = TEMPLATE) -> tuple[str, str, int, int] | None:
    """(role, text, where the escaped text stands) of the turn at a place of formatted text; None if it has no end yet."""
    found = TURN.match(text, at)
    if not found:
        return None
    label, body = found.groups()
    if not body.endswith(" ") or not (label.startswith("@") or label in template.labels.values()):
        raise ValueError(f"no turn: {text[at : at + 40]!r}")
    role = plain(label[1:]) if label.startswith("@") else {v: k for k, v in template.labels.items()}[label]
    return role, plain(body[:-1]), found.start(2), found.end()


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in turn order, by one shuffle."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """A row for each segment of each turn, in order within partitions.

    conversations: conv_id, turn, role, text. Turns are ordered by turn (null first),
    then role, then text; repeated rows are turns of their own. A null text or role is
    the empty string; rows with a null conv_id are one conversation. A turn whose role
    may not follow the one before is formatted all the same, with ok false. Other
    columns are not read; an empty table gives an empty result.

    Returns conv_id, turn_no int from 0, segment_no int, text, loss boolean, ok boolean.
    """

    def run(batches):
        now, state, number = object(), "^", 0
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != now:
                    now, state, number = conv, "^", 0
                ok = role in template.follows.get(state, ())
                for k, (piece, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, number, k, piece, loss, ok))
                state, number = role, number + 1
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "segment_no", "text", "loss", "ok"]).astype({"conv_id": "Int64"})

    return small_batches(turns_of(conversations)).mapInPandas(run, "conv_id long, turn_no int, segment_no int, text string, loss boolean, ok boolean")


def digests(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the formatted text of each conversation says when read back.

    segments: as format_chats returns them, conversations side by side and in order. A
    conversation's segments are joined to one text with its loss mask, and turns are
    found in that text alone: where segments begin and end plays no part. Text that is
    no turn is an error. Memory holds one turn.
    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    and valid boolean: every turn was in order.
    """

    def run(batches):
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        now, state, begun = object(), None, False

        def advance(force: bool = False):
            """Reads what turns the text held so far has."""
            text = "".join(state["text"])
            at = 0
            while at < len(text) and (turn := read_turn(text, at, template)):
                role, said, _, end = turn
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
                at = end
            if force and at < len(text):
                raise ValueError(f"no turn: {text[at : at + 40]!r}")
            # The mask's text up to there is complete, so no escape is cut in two.
            done = 0
            while state["mask"] and done < at:
                size, loss = state["mask"].pop(0)
                if loss:
                    under = plain(text[done : done + size])
                    state["loss"].update(under.encode())
                    state["loss_chars"] += len(under)
                done += size
            state["text"] = [text[at:]] if at < len(text) else []

        def result():
            advance(force=True)
            return (now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], bool(state["ok"]))

        for pdf in batches:
            out = []
            for conv, text, loss, ok in zip(pdf["conv_id"], pdf["text"], pdf["loss"], pdf["ok"]):
                conv = None if pd.isna(conv) else int(conv)
                if not begun or conv != now:
                    if begun:
                        out.append(result())
                    begun, now = True, conv
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ok": True, "text": [], "mask": []}
                state["text"].append(text)
                state["mask"].append((len(text), loss))
                state["chars"] += len(text)
                state["ok"] &= ok
                if text.endswith("</turn>\n"):
                    advance()
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        if begun:
            yield pd.DataFrame([result()], columns=columns).astype({"conv_id": "Int64"})

    return small_batches(segments).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
