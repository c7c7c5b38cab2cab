"""Operator 4: chat formatting of typed content parts."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.tables import table

START, SEP, STOP = "<|start|>", "<|sep|>", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
UNKNOWN = "<|unknown|>"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens of a placeholder: image patches of PATCH pixels, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 12.5, 512
FORMATTED = (
    "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:long,stop:long>>, "
    "attachments array<struct<turn:long,part:long,type:string,ref:string,at:long,tokens:long>>, attachment_tokens long"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|start\|>(.*?)<\|sep\|>(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without the opening of any control string: each ``<|`` gains a backslash inside."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class PartVisitor:
    """Flattens one conversation: text, loss spans and attachments, at code point offsets."""

    def __init__(self):
        self.pieces: list[str] = []
        self.at = 0
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def turn(self, number: int, role: str | None, parts: list[dict | None]) -> None:
        self.put(START + escape(role or "") + SEP)
        run = []  # neighbouring texts are escaped together, as a control string may span them
        for i, part in enumerate(parts):
            kind = part["type"] if part else "text"
            if kind == "text":
                run.append((part and part["text"]) or "")
                continue
            self.visit_text("".join(run), role)
            run = []
            visit = getattr(self, f"visit_{kind}") if kind in PLACEHOLDERS else self.visit_unknown
            self.attach(number, i, part, visit(part))
        self.visit_text("".join(run), role)
        self.put(STOP)

    def visit_text(self, text: str, role: str | None) -> None:
        if text:
            start = self.at
            self.put(escape(text))
            if role == "assistant":
                self.spans.append({"start": start, "stop": self.at})

    def visit_image(self, part: dict) -> int:
        return math.ceil(max(1, part["width"] or PATCH) / PATCH) * math.ceil(max(1, part["height"] or PATCH) / PATCH)

    def visit_audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0
        return max(1, math.ceil(seconds * FRAMES)) if math.isfinite(seconds) else 1

    def visit_document(self, part: dict) -> int:
        return max(1, part["pages"] or 1) * PAGE

    def visit_unknown(self, part: dict) -> int:
        return 1

    def attach(self, number: int, i: int, part: dict, tokens: int) -> None:
        self.attachments.append({"turn": number, "part": i, "type": part["type"], "ref": part["ref"], "at": self.at, "tokens": tokens})
        self.put(PLACEHOLDERS.get(part["type"], UNKNOWN))


def _format(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            out = []
            for row in batch.slice(lo, 200).to_pylist():
                v = PartVisitor()
                for number, t in enumerate(row["turns"]):
                    v.turn(number, t["role"], t["parts"] or [])
                out.append({
                    "conv_id": row["conv_id"], "formatted": "".join(v.pieces), "n_turns": len(row["turns"]), "loss_spans": v.spans,
                    "attachments": v.attachments, "attachment_tokens": sum(a["tokens"] for a in v.attachments),
                })
            yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, and text or parts): FORMATTED.

    A turn is START role SEP content STOP. Content parts are text, or images, audio and
    documents that become placeholders in their place; each placeholder's reference, offset
    and expanded token count is recorded in attachments. Control strings inside roles and
    texts are escaped reversibly. loss_spans are the code point spans of assistant texts.

    Turns are ordered by number (null first), equal ones by role, then text or parts; repeated
    rows are turns each. Null text is ''; null role is '' and never under the loss. A null
    conv_id is a conversation of its own. Extra columns are ignored; an empty table gives an
    empty result. A null part is an empty text; a part of an unknown or null type becomes the
    placeholder UNKNOWN of one token, its type and reference recorded like others'. Missing,
    negative, infinite or NaN sizes count as one patch, frame or page. A conversation becomes
    one value and so has to fit one task.
    """
    if "parts" in turns.columns:
        parts = F.col("parts").cast(PARTS)
    else:
        nothing = [F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
        parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *nothing))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", parts.alias("parts")))).alias("turns"))
    schema = _arrow(FORMATTED)
    return grouped.mapInArrow(lambda it: _format(it, schema), FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of the turns of a formatted conversation, unescaped."""
    return [(unescape(role), unescape(content)) for role, content in _TURN.findall(formatted)]


def _digest(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            out = []
            for row in batch.slice(lo, 200).to_pylist():
                text, turns = row["formatted"], parse(row["formatted"])
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in row["loss_spans"])
                out.append({
                    "conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": hexed("".join(f"{r}\n{t}\n" for r, t in turns)),
                    "loss_chars": len(loss), "loss_sha256": hexed(loss), "formatted_chars": len(text),
                })
            yield pa.RecordBatch.from_pylist(out, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss, from formatted text and spans alone."""
    schema = _arrow(DIGESTS)
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(lambda it: _digest(it, schema), DIGESTS)


HOSTILE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7 with control strings in its texts, read back from its formatted text."""
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.union(extra)))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{HOSTILE}'), (-7, 1, 'assistant', '{HOSTILE}'))),
e AS (SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS safe FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(safe) + length(role) + {len(START) + len(SEP) + len(STOP)}) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""
