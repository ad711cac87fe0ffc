"""Chat formatting with typed content parts.

A turn holds parts of text, image, audio or document.  A visitor with one
method for each type turns a part into what stands in the formatted text: text
with its control strings escaped, anything else as a numbered placeholder,
together with the attachment it refers to and the number of tokens that the
placeholder will be expanded to.  Turns are formatted independently of each
other; only reading back walks through whole conversations, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|n|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"<\\(\\*)\|")
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

# What a part may say about itself; fields that its type doesn't use are null.
PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)


def escape(text: Column) -> Column:
    r"""Put one more ``\`` into every ``<``, ``\``..., ``|``, so that no control string is left."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda found: f"<{found[1]}|", text)


@dataclass(frozen=True)
class TokenRule:
    """How many tokens a placeholder stands for."""

    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 512


class PartVisitor:
    """Visits a part by its type; each method gives (text, attachment type, tokens).

    A part without a type is text; one of an unknown type counts as a document.
    Missing measures count as one patch, no seconds, one page.
    """

    def __init__(self, rule: TokenRule) -> None:
        self.rule = rule

    def visit_text(self, part: Column) -> tuple[Column, Column, Column]:
        return escape(part["text"]), F.lit(None).cast("string"), F.lit(0).cast("long")

    def visit_image(self, part: Column) -> tuple[Column, Column, Column]:
        patch = float(self.rule.image_patch)
        wide = F.greatest(F.ceil(F.coalesce(part["width"], F.lit(1)) / patch), F.lit(1))
        high = F.greatest(F.ceil(F.coalesce(part["height"], F.lit(1)) / patch), F.lit(1))
        return F.lit("image"), F.lit("image"), (wide * high).cast("long")

    def visit_audio(self, part: Column) -> tuple[Column, Column, Column]:
        seconds = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
        return F.lit("audio"), F.lit("audio"), F.ceil(seconds * self.rule.audio_tokens_per_second).cast("long")

    def visit_document(self, part: Column) -> tuple[Column, Column, Column]:
        pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1))
        return F.lit("document"), F.lit("document"), (pages * self.rule.document_tokens_per_page).cast("long")

    def visit(self, part: Column) -> Column:
        """A struct of text, kind and tokens."""

        def shaped(visited: tuple[Column, Column, Column]) -> Column:
            text, kind, tokens = visited
            return F.struct(text.alias("text"), kind.alias("kind"), tokens.alias("tokens"))

        kind = F.coalesce(part["type"], F.lit("text"))
        return (
            F.when(kind == "text", shaped(self.visit_text(part)))
            .when(kind == "image", shaped(self.visit_image(part)))
            .when(kind == "audio", shaped(self.visit_audio(part)))
            .otherwise(shaped(self.visit_document(part)))
        )


def text_parts(text: Column) -> Column:
    """A turn of plain text as a list of one part."""
    fields = [text.alias("text") if f.name == "text" else F.lit(None).cast(f.dataType).alias(f.name) for f in PART]
    return F.array(F.struct(*fields))


def format_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    trained_roles: tuple[str, ...] = ("assistant",),
    rule: TokenRule = TokenRule(),
) -> DataFrame:
    """Every turn as a piece of its conversation's text; no shuffle.

    Returns conv_id, turn, segment (the formatted turn), loss_start and
    loss_length (code points of the segment under the loss mask; length 0 for
    roles that aren't trained on), attachments (in the order of their
    placeholders: position from 1 within the turn, kind, ref, tokens) and
    expanded_tokens (their sum).  A placeholder reads ``<|kind:position|>``.  A
    null role or text is empty, null parts are no parts; line breaks and
    control strings in a role are escaped like those in a text.  Columns of
    other names are ignored.
    """
    visitor = PartVisitor(rule)
    parts = F.filter(F.coalesce(F.col(parts_col), F.array().cast(T.ArrayType(PART))), lambda p: p.isNotNull())
    visited = F.transform(parts, lambda p: F.struct(p["ref"].alias("ref"), visitor.visit(p).alias("as")))
    held = F.filter(F.col("visited"), lambda v: v["as"]["kind"].isNotNull())
    attachments = F.transform(
        held,
        lambda v, i: F.struct(
            (i + 1).alias("position"), v["as"]["kind"].alias("kind"), v["ref"].alias("ref"), v["as"]["tokens"].alias("tokens")
        ),
    )
    # A fold keeps the text so far and the number of placeholders before.
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("count"))

    def step(so_far: Column, v: Column) -> Column:
        is_text = v["as"]["kind"].isNull()
        mark = F.concat(F.lit("<|"), v["as"]["kind"], F.lit(":"), (so_far["count"] + 1).cast("string"), F.lit("|>"))
        return F.struct(
            F.concat(so_far["text"], F.when(is_text, v["as"]["text"]).otherwise(mark)).alias("text"),
            (so_far["count"] + F.when(is_text, 0).otherwise(1)).alias("count"),
        )

    body = F.aggregate(F.col("visited"), start, step)["text"]
    role = F.replace(escape(F.col(role_col)), F.lit("\n"), F.lit(BREAK))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    trained = F.coalesce(F.col(role_col).isin(*trained_roles), F.lit(False))
    made = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        head.alias("head"),
        trained.alias("trained"),
        visited.alias("visited"),
    ).select("conv_id", "turn", "head", "trained", body.alias("body"), attachments.alias("attachments"))
    return made.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
        F.length("head").alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).alias("loss_length"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text that a segment was made from; placeholders stay in the text."""
    found = TURN.fullmatch(segment)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape(found[1].replace(BREAK, "\n")), unescape(found[2])


DIGEST = (
    "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks through conversations that arrive one after the other, turn by turn."""
    rows: list[tuple] = []
    state = None

    def closed() -> tuple:
        conv, turns, turn_hash, chars, loss_hash, formatted = state
        return conv, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted

    for block in batches:
        for conv, segment, start, length in zip(
            block["conv_id"],
            block["segment"],
            block["loss_start"],
            block["loss_length"],
            strict=True,
        ):
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(segment)
            masked = unescape(segment[start : start + length])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(masked)
            state[4].update(masked.encode())
            state[5] += len(segment)
        if rows:
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in DIGEST.split(", ")])
            rows = []
    if state is not None:
        yield pd.DataFrame([closed()], columns=[f.split()[0] for f in DIGEST.split(", ")])


def digest(formatted: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when it is read back.

    The rows of a conversation meet in one partition, sorted by turn (nulls
    first, equal turns by their text), and are hashed as they stream by; memory
    is that of one batch, however long a conversation is.  Rows without a
    conversation id form one conversation with a null id.
    """
    placed = formatted.select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", "segment", "loss_start", "loss_length"
    )
    ordered = placed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInPandas(_digests, DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))
