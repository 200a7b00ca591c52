"""Chat formatting with typed content parts.

A visitor walks a turn's parts in order: texts are escaped, images, audio and documents
become placeholders and leave an attachment reference with the tokens it expands
to. Each turn is one segment of its conversation's output,
so a conversation of any length is a sorted run of rows and never one
value in memory.

Template: `<|turn|>role<|says|>content<|end|>` and a newline. In texts (and roles) a backslash is
doubled and `<|` becomes `<\\|`, so no control string can occur inside one and the
escape can be undone. Defined results: null text or role is empty, a null turn sorts first, rows
of one turn are ordered by role then text, null conv_id is one conversation.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"


@dataclass(frozen=True)
class Expansion:
    """Tokens a placeholder stands for."""

    image_patch: int = 14
    image_default: int = 576
    audio_per_second: float = 25.0
    document_per_page: int = 1024


@dataclass
class Flat:
    """What a visit of a turn's parts gives."""

    text: str = ""
    attachments: list[dict] = field(default_factory=list)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


class Visitor:
    """Flattens parts; one method per kind, unknown kinds become documents of one page."""

    def __init__(self, expansion: Expansion = Expansion()):
        self.expansion = expansion

    def visit(self, parts: list) -> Flat:
        out = Flat()
        for part in parts:
            part = {"type": "text", "text": part} if isinstance(part, str) else part if isinstance(part, dict) else {"type": "text"}
            kind = part.get("type") or "text"
            getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_document")(part, out)
        return out

    def visit_text(self, part: dict, out: Flat) -> None:
        out.text += escape(part.get("text") or "")

    def attach(self, kind: str, part: dict, out: Flat, tokens: int) -> None:
        out.text += f"<|{kind}:{len(out.attachments)}|>"
        out.attachments.append({"kind": kind, "ref": str(part.get("ref") or part.get("url") or ""), "tokens": int(tokens)})

    def visit_image(self, part: dict, out: Flat) -> None:
        e, (w, h) = self.expansion, (part.get("width"), part.get("height"))
        self.attach("image", part, out, math.ceil(w / e.image_patch) * math.ceil(h / e.image_patch) if w and h else e.image_default)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self.attach("audio", part, out, math.ceil((part.get("seconds") or 0) * self.expansion.audio_per_second))

    def visit_document(self, part: dict, out: Flat) -> None:
        self.attach("document", part, out, (part.get("pages") or 1) * self.expansion.document_per_page)


def parts_of(text: str | None, content: str | None) -> list:
    """A turn's parts: the JSON list in `content`, else its text. Content that is no list is plain text."""
    if content is not None:
        try:
            parts = json.loads(content)
        except ValueError:
            parts = content
        return parts if isinstance(parts, list) else [content]
    return [text or ""]


SEGMENT = pa.schema(
    [
        ("formatted", pa.string()),
        ("loss_start", pa.int32()),
        ("loss_length", pa.int32()),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
    ]
)
SEGMENT_DDL = "formatted string, loss_start int, loss_length int, attachments array<struct<kind:string,ref:string,tokens:bigint>>"


def format_turn(role: str | None, text: str | None, content: str | None, visitor: Visitor, loss_roles: frozenset) -> tuple:
    flat = visitor.visit(parts_of(text, content))
    head = TURN + escape(role or "") + SAYS
    return head + flat.text + END, len(head), len(flat.text) if (role or "") in loss_roles else 0, flat.attachments


def format_turns(turns: DataFrame, *, content_col: str | None = None, expansion: Expansion = Expansion(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role, text (and JSON parts in `content_col`) to one segment row a turn:
    conv_id, turn, role, text, formatted, loss_start, loss_length (code points within formatted), attachments.

    A conversation's output is its segments joined in order of turn, role, text."""
    names = [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")]
    rows = turns.select(*[col(n).cast(t).alias(n) for n, t in names], (col(content_col).cast("string") if content_col else F.lit(None).cast("string")).alias("content"))
    roles = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor(expansion)
        for b in batches:
            got = [format_turn(*x, visitor, roles) for x in zip(*(b.column(n).to_pylist() for n in ("role", "text", "content")))]
            cols = [pa.array([x[i] for x in got], t) for i, t in enumerate(SEGMENT.types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], names=[n for n, _ in names] + SEGMENT.names)

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names) + ", " + SEGMENT_DDL)


def read_segment(formatted: str) -> tuple[str, str]:
    """Role and content text of a segment, unescaped. Placeholders stay as they are."""
    if not (formatted.startswith(TURN) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, content = formatted[len(TURN) : -len(END)].partition(SAYS)
    return unescape(role), unescape(content)


DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Running:
    """Digests of one conversation, fed a segment at a time."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns, self.under = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, length: int) -> None:
        role, text = read_segment(formatted)
        said = unescape(formatted[start : start + length])
        self.n, self.loss, self.chars = self.n + 1, self.loss + len(said), self.chars + len(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.under.update(said.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.under.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """Reads the formatted output back: one row a conversation with digests of its turns and of the text
    under the loss mask. Turns stream by in order, so memory does not grow with a conversation."""
    ordered = segments.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_length").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    ordered = ordered.select("conv_id", "formatted", "loss_start", "loss_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Running | None = None
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in DIGEST_DDL.split(", ")])

        for b in batches:
            done = []
            for conv, formatted, start, length in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Running(conv)
                now.add(formatted, start, length)
            if done:
                yield made(done)
        if now is not None:
            yield made([now.row()])

    return ordered.mapInArrow(run, DIGEST_DDL)
