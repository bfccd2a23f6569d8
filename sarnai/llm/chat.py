"""Chat formatting with typed content parts.

A message's content is a text or a list of parts, each ``{"type": "text" | "image" | "audio" | "document", ...}``.
A visitor flattens the parts, in order, into one text with a placeholder for each attachment, records what the
placeholder stands for, and counts the tokens it expands to. A turn is written as

    <|im_start|>role \\n content <|im_end|> \\n

Control strings start with ``<|``. In roles and texts one backslash goes between ``<`` and ``|``, after those that
are there already (``<|`` to ``<\\|``, ``<\\|`` to ``<\\\\|``), so no text holds a control string, and reading takes one
away. A line feed in a role is written ``<\\n|``, escaped in the same way before.

The reader works on the written text alone and gives back the turns; the loss mask is the spans of the written text that hold the content of
assistant turns (``loss_spans``). Placeholders found in the written text are matched, in order, with the recorded attachments: what is counted is
what was read, and a record without its placeholder is an error. Turns of a conversation are written and read one after the other in the order of turn, then
role, then text (nulls first), by a task that sorts on disk and holds one turn, so a conversation may have any
number of them. A null role or text is empty; conversations without an id form one. Repeated rows are turns of their own; an empty table
has no conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarnai.llm.common import to_arrow

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")
IMAGE_TILE, IMAGE_TOKENS = 448, 256  # pixels a side of a tile; tokens a tile
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 512
PROBE = "<|im_end|><|im_start|>assistant ok"
COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long, references_sha256 string"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A line feed would end the role: it becomes <n|, of which the role's own get a backslash."""
    return re.sub(r"<(\\*)n\|", r"<\\\1n|", escape(role)).replace("\n", "<n|")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"<\\(\\*)n\|", r"<\1n|", role.replace("<n|", "\n")))


@dataclass
class Flattened:
    text: str = ""  # escaped, with placeholders
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)  # offset in text, type, reference, tokens


class PartVisitor:
    """Visits the parts in order; a subclass may add ``visit_<type>``."""

    def __init__(self):
        self.out = Flattened()

    def visit(self, content) -> Flattened:
        if isinstance(content, str) or content is None:
            content = [{"type": "text", "text": content or ""}]
        for part in content:
            kind = part.get("type")
            method = getattr(self, f"visit_{kind}", None)
            if method is None:
                raise ValueError(f"unknown content part {kind!r}")
            method(part)
        return self.out

    def visit_text(self, part: dict) -> None:
        self.out.text += escape(part.get("text") or "")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.attachments.append((len(self.out.text), kind, str(part.get("ref") or ""), tokens))
        self.out.text += PLACEHOLDERS[kind]

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-int(part.get(k) or 1) // IMAGE_TILE)) for k in ("width", "height"))
        self._attach("image", part, across * down * IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round(float(part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(part.get("pages") or 1)) * DOCUMENT_TOKENS_PER_PAGE)


def write_turn(role: str | None, content) -> tuple[str, Flattened]:
    flat = PartVisitor().visit(content)
    return f"{START}{escape_role(role or '')}\n{flat.text}{END}\n", flat


def turn_spans(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, begin and end of the content) of each turn of a written text; a text that is none is an error."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if formatted[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError(f"turn not ended at {end}")
        yield unescape_role(formatted[at + len(START) : line]), line + 1, end
        at = end + len(END) + 1


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    return ((role, unescape(formatted[begin:end])) for role, begin, end in turn_spans(formatted))


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """The loss mask: where the content of assistant turns stands."""
    return [(begin, end) for role, begin, end in turn_spans(formatted) if role == "assistant"]


def read_attachments(content: str) -> list[tuple[int, str]]:
    """(offset, type) of the placeholders in the written content of a turn."""
    return [(m.start(), m[1]) for m in _PLACEHOLDER.finditer(content)]


def format_turns(messages: DataFrame, parts: bool = False) -> DataFrame:
    """conv_id, turn, role, text and the turn written out, its attachments and expanded tokens; no shuffle.

    parts: the text column holds JSON, either a string or a list of parts."""
    ddl = "conv_id long, turn long, role string, text string, formatted string, attachments array<struct<at:int,type:string,ref:string,tokens:long>>"
    arrow = to_arrow(messages.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            written = [write_turn(r, json.loads(t) if parts and t else t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            attached = [[dict(zip(("at", "type", "ref", "tokens"), a, strict=True)) for a in w[1].attachments] for w in written]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w[0] for w in written], pa.string()), pa.array(attached, arrow.field(5).type)], schema=arrow)

    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(run, ddl)


class Digest:
    """What is read back from a conversation's text, fed turn by turn."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.attachments = self.tokens = 0
        self.all, self.loss, self.references = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, recorded: list[dict]) -> None:
        self.chars += len(formatted)
        found = []
        for role, begin, end in turn_spans(formatted):
            content = formatted[begin:end]
            self.turns += 1
            self.all.update(f"{role}\n{unescape(content)}\n".encode())
            found += read_attachments(content)
        if found != [(a["at"], a["type"]) for a in recorded]:
            raise ValueError("the placeholders are not those recorded")
        self.attachments += len(found)
        for a in recorded:
            self.tokens += a["tokens"]
            self.references.update(f"{a['type']}\n{a['ref']}\n".encode())
        for begin, end in loss_spans(formatted):
            text = unescape(formatted[begin:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens, self.references.hexdigest()


def conversation_digests(messages: DataFrame, parts: bool = False) -> DataFrame:
    """A row per conversation, read back from its written form."""
    arrow = to_arrow(messages.sparkSession, COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, digest = [], None, None

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            rows.clear()
            return made

        for b in batches:
            for conv, formatted, attachments in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        rows.append(digest.row(now))
                    now, digest = conv, Digest()
                digest.feed(formatted, attachments)
            if len(rows) >= 10_000:
                yield batch()
        if digest is not None:
            rows.append(digest.row(now))
        if rows:
            yield batch()

    turns = format_turns(messages, parts)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "attachments").mapInArrow(run, COLUMNS)


def with_parts(messages: DataFrame) -> DataFrame:
    """conversations with typed content as JSON: every text, and with turns 0, 1 and 2 of each three an image, a sound of as many seconds
    as its conversation's id has in its last digit, and a document of a page, before, after and around it."""
    text = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    ref = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    blank = lambda kind, **more: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), *(v.alias(k) for k, v in more.items()))
    image = blank("image", width=F.lit(500) + F.col("turn") * 100, height=F.lit(400))
    audio = blank("audio", seconds=F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(10)))
    document = blank("document", pages=F.lit(1))
    joined = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *map(F.to_json, parts)), F.lit("]"))
    which = F.pmod(F.col("turn"), F.lit(3))
    content = F.when(which == 0, joined(image, text)).when(which == 1, joined(text, audio)).otherwise(joined(document, text, image))
    return messages.withColumn("text", content)


def with_probe(messages: DataFrame) -> DataFrame:
    """conversations plus conversation -1, whose texts are made of control strings."""
    rows = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    probe = messages.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


PARTS_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, ((turn % 3) + 3) % 3 AS which, coalesce(conv_id::VARCHAR, '') || CASE WHEN conv_id IS NULL THEN '' ELSE '/' END || turn AS ref,
    greatest(1, ceil((500 + turn * 100) / 448.0)) * 256 AS image, greatest(1, ((coalesce(conv_id, 0) % 10) + 10) % 10 * 25) AS audio
  FROM conversations
), told AS (
  SELECT *, CASE which WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS n, CASE which WHEN 0 THEN image WHEN 1 THEN audio ELSE 512 + image END AS tokens,
    CASE which WHEN 0 THEN 'image' || chr(10) || ref || chr(10) WHEN 1 THEN 'audio' || chr(10) || ref || chr(10)
      ELSE 'document' || chr(10) || ref || chr(10) || 'image' || chr(10) || ref || chr(10) END AS named
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sum(n)::BIGINT AS n_attachments, sum(tokens)::BIGINT AS expanded_tokens, sha256(string_agg(named, '' ORDER BY turn)) AS references_sha256
FROM told GROUP BY conv_id
"""
