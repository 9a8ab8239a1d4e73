"""Texts as seekable compressed frames, and the fill-in-middle transformation that works on them.

A text is stored as independent zstandard frames with the number of units (code points)
before each. A range of units is taken by decompressing only the frames that it cuts; whole
ones pass on as they are. Digests stream the frames in order. However long a text is,
only one frame of it is open at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.llm.common import released, text_buffers

FRAME_BYTES = 1 << 16
"""Most UTF-8 bytes of a frame as stored; frames joined later have at most twice as many."""
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAMES = "array<struct<units long, data binary>>"


class Frames:
    """Frames of one text under construction or read back: bytes and units of each."""

    def __init__(self, frames: list[dict] | None = None, limit: int = FRAME_BYTES):
        self.frames = frames or []
        self.limit, self.pending, self.waiting = limit, [], 0

    def add(self, text: str) -> None:
        self.pending.append(text)
        self.waiting += len(text)
        if self.waiting >= self.limit:
            self.close()

    def close(self) -> list[dict]:
        if self.waiting:
            text = "".join(self.pending)
            self.frames.append(shut_frame(text.encode()))
        self.pending, self.waiting = [], 0
        return self.frames

    def add_range(self, source: list[dict], start: int, end: int) -> None:
        """Units ``start`` to ``end`` of a stored text: large whole frames as they are, of cut and of small ones the text."""
        at = 0
        for frame in source:
            units = frame["units"]
            a, b = max(start - at, 0), min(end - at, units)
            at += units
            if a >= b:
                continue
            if b - a == units and 2 * units >= self.limit:
                self.close()
                self.frames.append(frame)
            else:
                self.add(open_frame(frame)[a:b])


_SQUEEZE = zstandard.ZstdCompressor(level=3)
_OPEN = zstandard.ZstdDecompressor()


def shut_frame(text: bytes) -> dict:
    return {"units": len(text.decode()), "data": _SQUEEZE.compress(text)}


def open_frame(frame: dict) -> str:
    return _OPEN.decompress(frame["data"]).decode()


def digest(frames: list[dict]) -> str:
    """SHA-256 of the text, in lower-case hex, frame by frame."""
    total = hashlib.sha256()
    for frame in frames:
        total.update(_OPEN.decompress(frame["data"]))
    return total.hexdigest()


def _cut(data, lo: int, hi: int, limit: int) -> Iterator[bytes]:
    """Bytes ``lo`` to ``hi`` in pieces of at most ``limit``, cut between characters."""
    while lo < hi:
        end = min(lo + limit, hi)
        while end < hi and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[lo:end].tobytes()
        lo = end


def _store(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            for first in range(0, len(at) - 1, 1000):
                last = min(first + 1000, len(at) - 1)
                rows = []
                for lo, hi in zip(at[first:last].tolist(), at[first + 1 : last + 1].tolist()):
                    rows.append([shut_frame(p) for p in _cut(data, lo, hi, limit)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([sum(f["units"] for f in r) for r in rows], pa.int64()),
                     pa.array(rows, _ARROW_FRAMES), batch.column(2).slice(first, last - first)], names=["doc_id", "n", "frames", "marked"])

    return run


_ARROW_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("data", pa.binary())]))


def store_texts(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n (code points), frames, marked: a table to write and to select ranges from.

    ``marked`` says whether the text holds one of the three markers. Null text: as the empty one, no
    frames. One row for each, repeated or without id alike; other columns are dropped.
    """
    if frame_bytes < 4:
        raise ValueError("a frame must hold a character")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), marked.alias("marked"))
    return rows.mapInArrow(released(_store(frame_bytes)), f"doc_id long, n long, frames {FRAMES}, marked boolean")


def select_range(frames: list[dict], start: int, end: int, limit: int = FRAME_BYTES) -> list[dict]:
    """Frames of the units ``start`` to ``end`` of a stored text."""
    out = Frames(limit=limit)
    out.add_range(frames, start, end)
    return out.close()


def arrange(frames: list[dict], form: str, first: int, second: int, n: int, limit: int = FRAME_BYTES) -> list[dict]:
    """Frames of the output: prefix, suffix and middle behind their markers, in the order of ``form``."""
    parts = {PREFIX: (0, first), SUFFIX: (second, n), MIDDLE: (first, second)}
    order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}.get(form)
    if order is None:
        return frames
    out = Frames(limit=limit)
    for mark in order:
        out.add(mark)
        out.add_range(frames, *parts[mark])
    return out.close()


def _find(frames: list[dict], marks: tuple[str, ...]) -> list[int]:
    """Unit positions of the first ``marks``, each behind the one before it, in one pass over the frames."""
    found, at, text = [], 0, ""
    for frame in frames:
        # a marker may lie across two frames: two characters of the one before are kept
        at, text = at + max(len(text) - 2, 0), text[-2:] + open_frame(frame)
        from_here = max(found[-1] + 3 - at, 0) if found else 0
        while len(found) < len(marks) and (hit := text.find(marks[len(found)], from_here)) >= 0:
            found.append(at + hit)
            from_here = hit + 3
        if len(found) == len(marks):
            return found
    raise ValueError("the output lacks a marker")


def restore(frames: list[dict], form: str, limit: int = FRAME_BYTES) -> list[dict]:
    """Frames of the text that an output of ``form`` was made of."""
    order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}.get(form)
    if order is None:
        return frames
    marks = _find(frames, order)
    ends = marks[1:] + [sum(f["units"] for f in frames)]
    part = {mark: (at + 3, end) for mark, at, end in zip(order, marks, ends)}
    out = Frames(limit=limit)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        out.add_range(frames, *part[mark])
    return out.close()


def _per_row(names: list[str], types: list[pa.DataType], row, drop: tuple[str, ...] = ()):
    """A batch function that keeps the columns of its input but ``drop`` and adds what ``row`` gives for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                made = [row(r) for r in part.to_pylist()]
                kept = [c for c in part.schema.names if c not in (*names, *drop)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names=kept + names)

    return released(run)


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, frames (of the output).

    h1 to h4 are 32-bit numbers of the digest of ``seed``, a colon and doc_id. Prefix and middle
    end at h1 % (n + 1) and h2 % (n + 1) code points, the smaller first. Form is plain if the text is
    empty or holds a marker, or if h3 % 100 >= ``plain_from``; else spm if h4 % 100 < ``spm_below``, else psm.

    Null text: as the empty one. Null doc_id: nothing follows the colon, so such rows are cut by the same
    numbers. Repeated rows are transformed alike. Empty table: no rows. Other columns are dropped.
    """
    stored = store_texts(docs, frame_bytes)
    digest_text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest_text, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    plain: Column = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= plain_from)
    form = F.when(plain, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = stored.select("doc_id", "n", form.alias("form"), F.when(~plain, F.least(a, b)).alias("prefix_chars"),
                        F.when(~plain, F.greatest(a, b) - F.least(a, b)).alias("middle_chars"), "frames")

    def row(r: dict) -> tuple:
        first = r["prefix_chars"] or 0
        return (arrange(r["frames"], r["form"], first, first + (r["middle_chars"] or 0), r["n"], frame_bytes),)

    return cut.mapInArrow(_per_row(["frames"], [_ARROW_FRAMES], row), f"doc_id long, n long, form string, prefix_chars long, middle_chars long, frames {FRAMES}")


def with_digests(made: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Adds output_sha256, and restored_sha256 of the text rebuilt from output and form; the frames go."""

    def row(r: dict) -> tuple:
        return digest(r["frames"]), digest(restore(r["frames"], r["form"], frame_bytes))

    return made.mapInArrow(_per_row(["output_sha256", "restored_sha256"], [pa.string(), pa.string()], row, ("frames",)),
                           "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def with_texts(made: DataFrame) -> DataFrame:
    """Adds ``text``, the whole output, for outputs that fit into a row."""
    return made.mapInArrow(_per_row(["text"], [pa.string()], lambda r: ("".join(map(open_frame, r["frames"])),)),
                           f"doc_id long, n long, form string, prefix_chars long, middle_chars long, frames {FRAMES}, text string")
