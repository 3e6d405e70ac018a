"""Chat formatting with typed content parts.

A message has parts: text, image, audio or document. A visitor (one column expression for each
kind) flattens them, in order, to text and placeholders, and records each attachment's reference
and the tokens its placeholder stands for. A turn is written as

    <|im_start|>role\\nbody<|im_end|>\\n

Control strings inside texts, this template's and those of other common ones, get a backslash
after their first character (one more if backslashes stand there already), which is turned back
exactly. The loss mask covers the bodies of the assistant's turns.

The formatted table has one row for each turn, so a conversation of any length is never held
whole: readers stream its rows in order. Rows with equal turns are ordered by what is formatted; a
null turn comes last; null roles, texts and parts count as empty; an unknown kind of part is taken
as text; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import written

#: This template's control strings, then those of other templates.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
CONTROL = (OPEN, CLOSE, *PLACEHOLDERS.values(), *FOREIGN)
#: Tokens a unit stands for: an image's units are patches, an audio's seconds, a document's pages.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 512}
PART = "struct<kind: string, text: string, ref: string, units: bigint>"

#: The first character, backslashes, and the rest of a control string.
_CONTROL_RE = "(?:" + "|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROL) + ")"
_ESCAPED_RE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_TURN_RE = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*){re.escape(CLOSE)}\n", re.S)


def escaped(text: Column) -> Column:
    """Control strings of a text made harmless."""
    return F.regexp_replace(text, F.lit(_CONTROL_RE), F.lit(r"\\"))


def unescape(text: str) -> str:
    return _ESCAPED_RE.sub("", text)


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def read_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def visitor() -> dict[str, Callable[[Column], Column]]:
    """What a part of each kind becomes."""

    def attachment(kind: str) -> Callable[[Column], Column]:
        return lambda p: F.struct(
            F.lit(PLACEHOLDERS[kind]).alias("body"),
            F.lit(kind).alias("kind"),
            p["ref"].alias("ref"),
            (F.greatest(F.coalesce(p["units"], F.lit(0)), F.lit(0)) * TOKENS_PER_UNIT[kind]).alias("tokens"),
        )

    return {kind: attachment(kind) for kind in PLACEHOLDERS}


def _text_part(p: Column) -> Column:
    none = F.lit(None)
    return F.struct(escaped(F.coalesce(p["text"], F.lit(""))).alias("body"), none.cast("string").alias("kind"), none.cast("string").alias("ref"), none.cast("bigint").alias("tokens"))


def flattened(parts: Column) -> Column:
    """array<struct<body, kind, ref, tokens>>: each part visited, in order."""

    def visit(p: Column) -> Column:
        out = None
        for kind, make in visitor().items():
            out = F.when(p["kind"] == kind, make(p)) if out is None else out.when(p["kind"] == kind, make(p))
        return out.otherwise(_text_part(p))

    return F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), visit)


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its message."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def format_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts to conv_id, turn, formatted, in_loss, body_start, body_end, attachments, expanded_tokens.

    body_start and body_end are code points within formatted; attachments are in order of their
    placeholders, each with its ordinal among the turn's parts.
    """
    flat = messages.select("conv_id", "turn", "role", flattened(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"))
    body = F.array_join(F.transform("flat", lambda p: p["body"]), "")
    placed = F.filter(F.transform("flat", lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda p: p["kind"].isNotNull())
    out = flat.select("conv_id", "turn", (F.coalesce("role", F.lit("")) == "assistant").alias("in_loss"), head.alias("head"), body.alias("body"), placed.alias("attachments"))
    return out.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("formatted"),
        "in_loss",
        F.length("head").alias("body_start"),
        (F.length("head") + F.length("body")).alias("body_end"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, p: a + p["tokens"]).alias("expanded_tokens"),
    )


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Read turns back from the formatted table: a digest of each conversation.

    Turns are streamed in order through running digests, so no conversation is held whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []

        def done() -> None:
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, text, in_loss, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    done()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = _TURN_RE.fullmatch(text)
                role, body = read_role(found[1]), unescape(found[2])
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                state[4] += len(text)
                if in_loss:
                    learnt = unescape(text[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
            if len(rows) > 10_000:
                yield batch_of()
                rows = []
        done()
        if rows:
            yield batch_of()

    slim = formatted.select("conv_id", "formatted", "in_loss", "body_start", "body_end", "turn")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "formatted")
    return ordered.drop("turn").mapInArrow(read, DIGEST)


def chat_round_trip(conversations: DataFrame) -> DataFrame:
    """Format plain conversations (conv_id, turn, role, text), write the table, read it back."""
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text_parts(F.col("text")).alias("parts"))
    return read_conversations(written(format_messages(messages), "chat"))
