"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and only that reply is trainable. Turns behind
the last reply make one more example without a target, so the output holds every turn and can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Put behind the "<" of any "<|" or "<\" of a text; no control string can then occur inside a turn.
MARK = "\\"
TARGET_ROLE = "assistant"
#: Output rows are handed on in batches of about so many characters.
BATCH_CHARS = 4 << 20

EXAMPLES = "conv_id long, example int, n_context_turns int, text string, target_start long, target_end long"


def escape(text: str) -> str:
    """Reversible: "<", any number of marks, "|" gets one mark more."""
    return text if "<" not in text else _GROW.sub(lambda m: "<" + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return text if "<" not in text else _SHRINK.sub(lambda m: "<" + m[0][2:], text)


def _patterns():
    import re

    return re.compile(r"<\\*\|"), re.compile(r"<\\+\|"), re.compile(r"\\[n\\]")


_GROW, _SHRINK, _SPELLED = _patterns()


def escape_role(role: str) -> str:
    """A role ends at its line's end, so line ends and marks inside it are spelled out."""
    return escape(role.replace(MARK, MARK * 2).replace("\n", MARK + "n"))


def unescape_role(role: str) -> str:
    return _SPELLED.sub(lambda m: "\n" if m[0][1] == "n" else MARK, unescape(role))


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a turn; the body alone can be trained on."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    size, conv, context, turns, number, pending = 0, None, "", 0, 0, False

    def tail():
        return [(conv, number, turns, context, -1, -1)] if pending else []

    for pdf in batches:
        for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
            if c != conv:
                rows += tail()
                conv, context, turns, number, pending = c, "", 0, 0, False
            head, body, end = format_turn(role, text)
            if role == TARGET_ROLE:
                start = len(context) + len(head)
                context += head + body + end
                rows.append((conv, number, turns, context, start, start + len(body)))
                size += len(context)
                number, pending = number + 1, False
            else:
                context += head + body + end
                pending = True
            turns += 1
            if size > BATCH_CHARS:
                yield pd.DataFrame(rows, columns=["conv_id", "example", "n_context_turns", "text", "target_start", "target_end"])
                rows, size = [], 0
    rows += tail()
    if rows:
        yield pd.DataFrame(rows, columns=["conv_id", "example", "n_context_turns", "text", "target_start", "target_end"])


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, example, n_context_turns, text, target_start, target_end) of (conv_id, turn, role, text).

    target_start/end are code points of text under the loss mask, -1 without a target. Rows stream through a task sorted by
    conversation and turn (null turns first; equal turns by role, then text), so a task holds one conversation's text, not
    its examples. Null role or text: empty; rows without conv_id are dropped, as no conversation owns them. Repeated rows
    are turns of their own; other columns are ignored.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(_expand, EXAMPLES)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted text; start and end bound the escaped body."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith(START, at), "not a turn"
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


READ = "conv_id long, example int, chars long, n_turns long, turns_sha string, target string, sha string, before_sha string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Examples, each read back whole: its turns' digest, its target, and digests of itself and of what the example before it must be."""
    for pdf in batches:
        out = []
        for c, e, text, start, end in zip(pdf["conv_id"], pdf["example"], pdf["text"], pdf["target_start"], pdf["target_end"]):
            turns = parse(text)
            said, before = hashlib.sha256(), 0
            for role, body, a, z in turns:
                said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                if role == TARGET_ROLE and a != start:
                    before = z + len(END) + 1
            target = unescape(text[start:end]) if start >= 0 else None
            whole, part = (hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (text, text[:before]))
            out.append((c, e, len(text), len(turns), said.hexdigest(), target, whole, part))
        yield pd.DataFrame(out, columns=["conv_id", "example", "chars", "n_turns", "turns_sha", "target", "sha", "before_sha"])


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation of what was read back, sorted by conversation and example."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    out, conv = [], None
    turns = loss = chars = n = 0
    said, sha, all_loss = "", "", hashlib.sha256()

    def done():
        return [(conv, turns, said, loss, all_loss.hexdigest(), chars, n)] if conv is not None else []

    for pdf in batches:
        for row in pdf.itertuples():
            if row.conv_id != conv:
                out += done()
                conv, loss, chars, n, all_loss = row.conv_id, 0, 0, 0, hashlib.sha256()
                sha = hashlib.sha256().hexdigest()
            if row.before_sha != sha:
                raise ValueError(f"conversation {conv}: example {row.example} doesn't begin with the one before it")
            if row.target is not None:
                loss += len(row.target)
                all_loss.update(row.target.encode("utf-8", "surrogatepass"))
            turns, said, sha, chars, n = row.n_turns, row.turns_sha, row.sha, chars + row.chars, n + 1
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    out += done()
    if out:
        yield pd.DataFrame(out, columns=columns)


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the examples, in whatever order they come.

    Every example is parsed whole; one that doesn't begin with the example before it raises an error. Only targets and
    digests are dealt out by conversation.
    """
    read = examples.mapInPandas(_read, READ).repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return read.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
