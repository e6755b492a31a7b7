"""Chat formatting (operator 4) by columnar byte assembly.

The turns of many conversations are laid out at once: lengths of all segments
(header, content, end of turn) give offsets by a cumulative sum, and headers
and contents are scattered into one preallocated buffer, which becomes the
Arrow string column without another copy.

Control strings inside a text are written with a backslash before their last
character; one that already has backslashes there gets one more.  Taking one
away gives the text back, and no control string of a text survives formatting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """Marks of turns, and the control strings that texts must not smuggle in."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        for a in self.controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"{a!r} can't be escaped")
            for b in self.controls:
                if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"{a!r} and {b!r} overlap")
        if not any(c in self.start for c in self.controls):
            raise ValueError("the mark of a turn holds no control string")

    def escape(self, texts: pa.Array) -> pa.Array:
        for c in self.controls:
            if pc.any(pc.match_substring(texts, c[:-1])).as_py():
                texts = pc.replace_substring_regex(texts, rf"({re.escape(c[:-1])})(\\*)({re.escape(c[-1])})", r"\1\2\\\3")
        return texts

    def unescape(self, text: str) -> str:
        if "\\" in text:
            for c in self.controls:
                text = re.sub(rf"({re.escape(c[:-1])})\\(\\*)({re.escape(c[-1])})", r"\1\2\3", text)
        return text

    def header(self, role: str) -> str:
        role = role.replace("\\", "\\\\").replace("\n", "\\n")
        return self.start + self.escape(pa.array([role]))[0].as_py() + self.after_role

    def role(self, written: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(written))

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        out = []
        for piece in formatted.split(self.start)[1:]:
            role, _, rest = piece.partition(self.after_role)
            if not rest.endswith(self.end):
                raise ValueError("a turn has no end")
            out.append((self.role(role), self.unescape(rest[: -len(self.end)])))
        return out


def _scatter(to: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy source[start : start + length] to to[at:] for each segment."""
    place = np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    to[place] = source[np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())]


def assemble(rows: pa.RecordBatch, template: Template, trained: str) -> pa.RecordBatch:
    """rows of whole conversations, in order -> conv_id, formatted, loss_start, loss_length (code points)."""
    ids = rows.column("conv_id")
    n = len(ids)
    new = np.ones(n, dtype=bool)
    if n > 1:
        a, b = ids.slice(1), ids.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
        new[1:] = ~same
    first = np.flatnonzero(new)
    texts, text_at = common.text_bytes(template.escape(rows.column("text").fill_null("")))
    roles = rows.column("role").fill_null("").dictionary_encode()
    names = roles.dictionary.to_pylist()
    heads = [np.frombuffer(template.header(r).encode(), np.uint8) for r in names]
    which = roles.indices.to_numpy()
    tail = np.frombuffer(template.end.encode(), np.uint8)

    head_len = np.array([len(h) for h in heads])[which]
    text_len = np.diff(text_at)
    ends = np.cumsum(head_len + text_len + len(tail))
    starts = np.concatenate([[0], ends[:-1]])
    if ends[-1] >= 2**31:
        raise ValueError("conversations of 2 GB and more have no room in a string column")
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    for k, h in enumerate(heads):
        out[starts[which == k][:, None] + np.arange(len(h))] = h
    out[(ends - len(tail))[:, None] + np.arange(len(tail))] = tail
    body = starts + head_len
    _scatter(out, body, texts, text_at[:-1], text_len)

    points = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    conv_at = starts[first]
    of = np.cumsum(new) - 1
    learn = np.flatnonzero((which == names.index(trained)) & (text_len > 0)) if trained in names else np.zeros(0, int)
    lists = np.concatenate([[0], np.cumsum(np.bincount(of[learn], minlength=len(first)))]).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(conv_at, len(out)).astype(np.int32)), pa.py_buffer(out))
    return pa.record_batch(
        [
            ids.take(pa.array(first)), strings,
            pa.ListArray.from_arrays(lists, pa.array(points[body[learn]] - points[conv_at[of[learn]]])),
            pa.ListArray.from_arrays(lists, pa.array(points[body[learn] + text_len[learn]] - points[body[learn]])),
        ],
        ["conv_id", "formatted", "loss_start", "loss_length"],
    )


def format_chats(turns: DataFrame, template: Template = Template(), *, trained: str = "assistant", most: int = common.CHUNK_BYTES) -> DataFrame:
    """One row for each conversation: conv_id, formatted, and the spans under the loss mask in code points.

    turns has conv_id, turn, role, text.  Rows go by turn, null first; rows of
    the same turn by role and text, repeated rows stay.  A null text or role is
    empty.  Rows with a null conv_id make one conversation.  Other columns are ignored.
    A conversation of 2 GB or more, which no string column can hold, is an error.
    """
    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    source = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return assemble(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], template, trained)

        for b in common.chunks(batches, "text", most):
            if held:
                # Rows of the conversation that is under way come first in b.
                last = held[-1].column("conv_id")[-1]
                ids = b.column("conv_id")
                other = pc.is_valid(ids) if not last.is_valid else pc.fill_null(pc.not_equal(ids, last), True)
                cut = pc.index(other, True).as_py()
                if cut < 0:
                    held.append(b)
                    continue
                if size >= most or cut:
                    if cut:
                        held.append(b.slice(0, cut))
                    yield done(held)
                    held, size, b = [], 0, b.slice(cut)
            held.append(b)
            size += b.nbytes
        if held:
            yield done(held)

    return source.mapInArrow(run, "conv_id long, formatted string, loss_start array<long>, loss_length array<long>")


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "formatted"):
            out = []
            for text, start, length in zip(b.column("formatted").to_pylist(), b.column("loss_start").to_pylist(), b.column("loss_length").to_pylist(), strict=True):
                turns = template.parse(text)
                loss = "".join(template.unescape(text[s : s + k]) for s, k in zip(start, length, strict=True))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*out, strict=True)
            yield pa.record_batch([b.column("conv_id"), *map(pa.array, columns)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
