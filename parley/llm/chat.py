"""Operator 5: chat formatting by columnar byte assembly.

A turn is `### role: text</turn>` and a line feed. In role and text a backslash goes before
each of the characters that control strings begin with, so that the format can be read back.
For a whole Arrow batch, segment lengths, cumulative offsets and scatter indices are computed
in numpy, and all bytes are copied into one buffer made beforehand.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, utf8

#: The template's fixed parts.
BEGIN, MIDDLE, END = b"### ", b": ", b"</turn>\n"
_IN_TEXT, _IN_ROLE = np.zeros(256, bool), np.zeros(256, bool)
_IN_TEXT[list(b"\\#<")] = True
_IN_ROLE[list(b"\\#<:")] = True


def _escaped(data: np.ndarray, offsets: np.ndarray, special: np.ndarray):
    """Where each byte goes in the escaped texts laid end to end, and those texts' offsets."""
    marks = special[data]
    at = np.arange(len(data)) + np.cumsum(marks)
    return at, np.flatnonzero(marks), offsets + np.concatenate(([0], np.cumsum(marks)))[offsets]


def assemble(roles: pa.Array, texts: pa.Array):
    """One buffer with all formatted turns, their offsets, and each text's range in the buffer."""
    role, role_off = utf8(roles)
    text, text_off = utf8(texts)
    role_at, role_marks, role_end = _escaped(role, role_off, _IN_ROLE)
    text_at, text_marks, text_end = _escaped(text, text_off, _IN_TEXT)
    n_role, n_text = np.diff(role_end), np.diff(text_end)
    offsets = np.concatenate(([0], np.cumsum(len(BEGIN) + n_role + len(MIDDLE) + n_text + len(END))))
    start = offsets[:-1]
    role_start = start + len(BEGIN)
    text_start = role_start + n_role + len(MIDDLE)
    out = np.full(int(offsets[-1]), ord("\\"), np.uint8)
    for fixed, where in ((BEGIN, start), (MIDDLE, role_start + n_role), (END, text_start + n_text)):
        for i, byte in enumerate(fixed):
            out[where + i] = byte
    for data, at, off, end, begin in ((role, role_at, role_off, role_end, role_start), (text, text_at, text_off, text_end, text_start)):
        out[at + np.repeat(begin - end[:-1], np.diff(off))] = data
    return out, offsets, text_start, text_start + n_text


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment string, mask_start, mask_end) for each row of turns
    (conv_id, turn, role, text): the loss mask is a byte range of the segment, that of an
    assistant's text and empty for other roles. A conversation's string is its segments in
    order of turn. Row-local. A null role or text is empty; other columns are not read."""

    def run(batches):
        for b in batches:
            out, offsets, start, end = assemble(b.column(2), b.column(3))
            mine = np.array([r == "assistant" for r in b.column(2).to_pylist()], bool)
            base = offsets[:-1]
            segment = pa.Array.from_buffers(pa.large_string(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
            columns = [b.column(0), b.column(1), b.column(2), segment, pa.array(np.where(mine, start - base, 0)), pa.array(np.where(mine, end - base, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "segment", "mask_start", "mask_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, segment string, mask_start long, mask_end long")


# in runs that are never given back, so that a long text is neither held nor tried character by character
_PARTS = re.compile(rb"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)


def unescape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", text)


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the
    formatted segments alone. Turns of one number are ordered by segment; rows without conv_id
    are one conversation. Segments stream through a task in order, so that a long conversation
    takes time but no memory."""

    def run(batches):
        now, none = None, object()
        conv = none
        for b in batches:
            done = []
            for c, segment, lo, hi in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append(_finish(conv, now))
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = segment.encode()
                at = 0
                while at < len(raw):
                    m = _PARTS.match(raw, at)
                    role, text = unescape(m[1]), unescape(m[2])
                    now[0] += 1
                    now[1].update(role + b"\n" + text + b"\n")
                    at = m.end()
                loss = unescape(raw[lo:hi])
                now[2] += len(loss.decode())
                now[3].update(loss)
                now[4] += len(segment)
            if done:
                yield _digests(done)
        if conv is not none:
            yield _digests([_finish(conv, now)])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "mask_start", "mask_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _finish(conv, now) -> tuple:
    return (conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(more)))
