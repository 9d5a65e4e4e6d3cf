"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, one turn a line: `### role: text</turn>`. Texts and roles can't forge a
mark: a backslash stands before each of their characters that marks are made of, and reading takes it off.
The rendered text is encoded once, with the offsets of its tokens. Both the texts of the turns to learn and
the tokens are sorted spans of it; binary search finds each turn's first and last token, and what the two
share is the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridoc.llm.common import small_batches, whole

TOKENIZER = "byte_bpe_50k.json"
LEARNED = "assistant"
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
MARKS = re.compile(r"[\\#<:]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return MARKS.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each text to learn in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{AFTER_ROLE}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises where it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@cache
def load(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(which tokens share a character with a span, the characters of the spans that tokens cover).

    `offsets` has a row (start, end) for each token, sorted, as have the spans.
    """
    chosen = np.zeros(len(offsets), np.int8)
    covered = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if a < b and i < j:
            chosen[i:j] = 1
            covered.append((max(a, int(starts[i])), min(b, int(ends[j - 1]))))
    return chosen, covered


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, ids, loss_mask, loss_spans): a row for each conversation, with the tokens of its whole text.

    Turns are ordered by turn, then role and text where turns tie (rows repeated are turns of their own);
    a null turn comes first, a null role or text is empty, rows with a null id are one conversation. Other
    columns are ignored. `loss_spans` are the characters of `formatted` under the mask.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), whole(F.col(role_col)).alias("role"), whole(F.col(text_col)).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", "turns.role", "turns.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(tokenizer)
        for b in batches:
            made = [render(zip(roles, texts, strict=True), learned) for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            encoded = t.encode_batch([text for text, _ in made], add_special_tokens=False)
            masks = [mask(np.array(e.offsets, np.int64).reshape(-1, 2), spans) for e, (_, spans) in zip(encoded, made, strict=True)]
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([text for text, _ in made], pa.string()),
                    pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                    pa.array([m for m, _ in masks], pa.list_(pa.int8())),
                    pa.array([[{"start": x, "end": y} for x, y in c] for _, c in masks], pa.list_(span)),
                ],
                names=["conv_id", "formatted", "ids", "loss_mask", "loss_spans"],
            )

    kind = turns.schema[id_col].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: turns, text under the loss mask, lengths."""
    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
