"""Repeated passages: longest-previous-factor arrays over suffixes that share an anchor.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller
doc_id, or the same document further left). Each such string has an anchor: the GRAM-byte
run of smallest hash in it, the leftmost of equals. Equal strings have equal anchors at
the same place, so only suffixes with a common anchor need comparing, wherever they are.

1. Anchors. The strings with the same anchor occurrence start in one short range; the text
   that they span is the anchor's context. Copies of a whole context are found by its hash:
   the first keeps its bytes, of the others every byte goes.
2. Anchors that occur in several different contexts (at the ends of passages, around edits)
   send one copy of each context. The suffixes that start the strings are put in suffix
   order; previous and next smaller positions give the longest previous factor of each,
   and a factor of LENGTH bytes or more marks the string.
3. The marks return to the documents.

Blocks of anchors travel packed; Spark deals them by anchor, and marks and texts by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.common import U64, blocks, mix, released, small_side, text_buffers
from mosaiq.session import cut_lineage

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1

FLUSH = 1_200_000
"""Anchors that a task looks at together before it sends them on."""

HOT = 2048
"""Contexts of one anchor beyond which their suffixes are dealt by their own hash."""

_ROLL = [int(x) | 1 for x in np.random.default_rng(20).integers(1 << 62, size=8)]
_BYTE = np.random.default_rng(21).integers(1 << 63, size=256).astype(U64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 512 << 10) + 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, dtype=U64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def anchors(part: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Anchor occurrences of texts: number of the text, start of the first string and how many more start (``span``),
    distance of the anchor (``off``), and the hashes of anchor and context."""
    n = len(part)
    doc = np.zeros(0, np.int64)
    none = {"doc": doc, "lo": doc, "span": doc, "off": doc, "gram": np.zeros(0, U64), "context": np.zeros(0, U64)}
    if n < LENGTH:
        return none
    value = _BYTE[part]
    h, width = value, 1
    while width < GRAM:
        h = h[: len(h) - width] * U64(_ROLL[width.bit_length()]) + h[width:]
        width *= 2
    h = mix(h)
    size = np.diff(at)
    starts = np.maximum(size - LENGTH + 1, 0)  # strings of each text
    # low half: place, so that the minimum tells where it is and equals go to the left
    low = (h & ~U64(0xFFFFFFFF)) | np.arange(len(h), dtype=U64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = WINDOW - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    owner = np.repeat(np.arange(len(size)), starts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + at[:-1][owner]
    if not len(place):
        return none
    anchor = (low[place] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    begin, end = place[first], place[last] + LENGTH
    up, down = _power_tables(n)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(value * up[:n], dtype=U64)])
    context = (total[end] - total[begin]) * down[begin]
    a, span, off = anchor[first], last - first, anchor[first] - begin
    context = mix(context + U64(0xD1B54A32D192ED03) * (span.astype(U64) + (off.astype(U64) << U64(8)) + U64(1)))
    return {"doc": owner[first], "lo": begin - at[:-1][owner[first]], "span": span, "off": off,
            "gram": mix(h[a] ^ U64(_BASE)), "context": context}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def previous_factors(suffixes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest-previous-factor lengths, up to the width of ``suffixes`` (n x width bytes).

    ``order`` tells which suffix starts earlier (equal: the same place). In suffix order,
    the nearest suffix on either side with a smaller start shares the longest factor that
    occurs before; its length is the smallest common prefix on the way.
    """
    n, width = suffixes.shape
    if not n:
        return np.zeros(0, np.int64)
    rows = np.ascontiguousarray(suffixes)
    by = np.lexsort((order, rows.view(f"S{width}").ravel()))
    rows, rank = rows[by], order[by]
    lcp = np.zeros(n, dtype=np.int64)
    differ = rows[1:] != rows[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    best = np.zeros(n, dtype=np.int64)
    for side in (1, -1):
        near, value = (lcp, rank) if side == 1 else (np.append(lcp[1:], 0)[::-1], rank[::-1])
        link, least = np.arange(n) - 1, near.copy()
        open_ = np.flatnonzero((link >= 0) & (least > 0))
        while len(open_):
            # not smaller: go on to where that one looks, over the common prefix on the way
            open_ = open_[value[link[open_]] >= value[open_]]
            to = link[open_]
            least[open_] = np.minimum(least[open_], least[to])
            link[open_] = link[to]
            open_ = open_[(link[open_] >= 0) & (least[open_] > 0)]
        found = np.where(link >= 0, least, 0)
        best = np.maximum(best, found if side == 1 else found[::-1])
    out = np.empty(n, dtype=np.int64)
    out[by] = best
    return out


_PACK = "bucket int, kind byte, gram binary, context binary, local binary, lo binary, span binary, off binary, docs binary"
_MARKS = "bucket int, kind byte, doc binary, lo binary, span binary, off binary, gram binary"


_TYPES = {"doc": np.int64, "lo": np.uint32, "span": np.uint8, "off": np.uint8, "gram": U64}


def _packed(bucket: int, kind: int, x: dict[str, np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
    docs, local = np.unique(x["doc"], return_inverse=True)
    return pa.RecordBatch.from_arrays([
        pa.array([bucket], pa.int32()), pa.array([kind], pa.int8()), *(pa.array([a.tobytes()], pa.binary()) for a in (
            x["gram"], x["context"], local.astype(np.uint32), x["lo"].astype(np.uint32), x["span"].astype(np.uint8), x["off"].astype(np.uint8), ids[docs]))],
        names=[c.split()[0] for c in _PACK.split(", ")])


def _later_copies(x: dict[str, np.ndarray], ids: np.ndarray | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows of the first occurrence of each context and of its later ones (other rows of the same place are left out), by anchor."""
    doc = ids[x["doc"]] if ids is not None else x["doc"]
    order = np.lexsort((x["lo"], doc, x["context"], x["gram"]))
    x, doc = {k: v[order] for k, v in x.items()}, doc[order]
    first = _runs(x["gram"], x["context"])
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    return x, first, (doc != doc[at]) | (x["lo"] != x["lo"][at])


def _pack_found(x: dict[str, np.ndarray], ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs what a task has found: first occurrences by anchor (kind 0), later ones, which are settled, by document (kind 1)."""
    x, once, later = _later_copies(x, ids)
    for kind, rows in ((0, once), (1, later)):
        part = {k: v[rows] for k, v in x.items()}
        key = part["gram"] if kind == 0 else mix(ids[part["doc"]].view(U64))
        if kind == 1:
            part["gram"] = part["context"] = np.zeros(0, U64)
        bucket = (key >> U64(48)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            at = order[cut[b] : cut[b + 1]]
            yield _packed(b, kind, {k: v[at] if len(v) else v for k, v in part.items()}, ids)


def _find(buckets: int):
    """Anchors of texts, packed by bucket. What is a later copy inside the task's own texts is settled here (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        ids: list[np.ndarray] = []
        docs = size = 0

        for batch in batches:
            data, at = text_buffers(batch.column(1))
            name = np.asarray(batch.column(0))
            for first, last in blocks(at):
                lo = int(at[first])
                x = anchors(data[lo : int(at[last])], at[first : last + 1] - lo)
                x["doc"] = x["doc"] + docs
                held.append(x)
                ids.append(name[first:last])
                docs += last - first
                size += len(x["lo"])
                if size >= FLUSH:
                    yield from _pack_found({k: np.concatenate([h[k] for h in held]) for k in x}, np.concatenate(ids), buckets)
                    held, ids, docs, size = [], [], 0, 0
        if held:
            yield from _pack_found({k: np.concatenate([h[k] for h in held]) for k in held[0]}, np.concatenate(ids), buckets)

    return run


def _deal_marks(kind: int, x: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (doc, lo, span, off, gram), ``doc`` the id itself, packed by the document's bucket."""
    bucket = (mix(x["doc"].view(U64)) >> U64(48)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        at = order[cut[b] : cut[b + 1]]
        yield pa.RecordBatch.from_arrays([
            pa.array([b], pa.int32()), pa.array([kind], pa.int8()), *(pa.array([x[k][at].astype(t).tobytes() if k in x else b""], pa.binary()) for k, t in _TYPES.items())],
            names=[c.split()[0] for c in _MARKS.split(", ")])


def _settle(buckets: int):
    """Per bucket of anchors: later copies of contexts (kind 1), and one copy of each context of an anchor that has several (kind 0)."""

    def bucket(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        open_ = {k: [] for k in ("gram", "context", "doc", "lo", "span", "off")}
        for r in rows:
            docs = np.frombuffer(r["docs"], np.int64)
            doc = docs[np.frombuffer(r["local"], np.uint32)]
            lo, span, off = np.frombuffer(r["lo"], np.uint32), np.frombuffer(r["span"], np.uint8), np.frombuffer(r["off"], np.uint8)
            if r["kind"]:
                yield from _deal_marks(1, {"doc": doc, "lo": lo, "span": span}, buckets)
                continue
            for k, v in zip(open_, (np.frombuffer(r["gram"], U64), np.frombuffer(r["context"], U64), doc, lo, span, off)):
                open_[k].append(v)
        if not open_["gram"]:
            return
        x, first, later = _later_copies({k: np.concatenate(v) for k, v in open_.items()}, None)
        anchor = np.cumsum(_runs(x["gram"])) - 1
        several = np.bincount(anchor, first)[anchor] > 1
        yield from _deal_marks(1, {k: x[k][later] for k in ("doc", "lo", "span")}, buckets)
        yield from _deal_marks(0, {k: v[first & several] for k, v in x.items()}, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield from bucket(held)
                    held = []
                held.append(r)
        if held:
            yield from bucket(held)

    return run


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    """(marks, texts) of runs of documents of one sorted partition: a bucket's marks come before its texts."""
    marks: list[dict] = []
    now = None
    for batch in batches:
        texts: list[dict] = []
        for r in batch.to_pylist():
            if r["bucket"] != now:
                if texts:
                    yield marks, texts
                marks, texts, now = [], [], r["bucket"]
            (marks if r["kind"] < 2 else texts).append(r)
        if texts:
            yield marks, texts


def _by_document(marks: list[dict]) -> dict[str, np.ndarray]:
    x = {k: np.concatenate([np.zeros(0, t), *(np.frombuffer(m[k], t) for m in marks)]) for k, t in _TYPES.items()}
    order = np.argsort(x["doc"], kind="stable")
    return {k: v[order] for k, v in x.items() if len(v)}


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of each context asked for: (gram, doc, lo, off, text)."""
    known: tuple[list[dict], dict[str, np.ndarray]] | None = None
    for marks, texts in _with_texts(batches):
        if known is None or known[0] is not marks:
            known = (marks, _by_document(marks))
        x = known[1]
        out: list[list] = [[], [], [], [], []]
        for r in texts:
            a, b = np.searchsorted(x["doc"], [r["doc_id"], r["doc_id"] + 1]) if x else (0, 0)
            if a == b:
                continue
            raw = r["text"].encode()
            for k in range(a, b):
                lo = int(x["lo"][k])
                for c, v in zip(out, (x["gram"][k : k + 1].view(np.int64)[0], r["doc_id"], lo, int(x["off"][k]), raw[lo : lo + int(x["span"][k]) + LENGTH])):
                    c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["gram", "doc", "lo", "off", "part"])


def _suffixes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of contexts as rows of bytes, and the row, document and start of each."""
    parts = table["part"].combine_chunks()
    at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    data = np.frombuffer(parts.buffers()[2], np.uint8)
    n = np.diff(at) - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[:-1][row] + step]
    return strings, row, np.asarray(table["doc"])[row], np.asarray(table["lo"])[row] + step


def _factor_marks(buckets: int):
    """Strings with an earlier copy among the contexts of their anchor, as marks of one string each."""

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        strings, row, doc, start = _suffixes_of(table)
        # suffixes of different anchors never meet: the anchor goes in front of each
        gram = np.asarray(table["gram"])[row]
        order = np.lexsort((start, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(_runs(doc[order], start[order]))
        wide = np.concatenate([np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8), strings], axis=1)
        hit = previous_factors(wide, rank) >= LENGTH + 8
        doc, start = doc[hit], start[hit]
        yield from _deal_marks(1, {"doc": doc, "lo": start, "span": np.zeros(len(doc), np.uint8)}, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            gram = np.asarray(batch.column(0))
            edges = np.append(np.flatnonzero(_runs(gram)), len(gram)) if len(gram) else []
            for a, b in zip(edges, edges[1:]):
                # whole groups together, some thousand contexts at a time
                if rows >= HOT and held[-1].column(0)[0].as_py() != gram[a]:
                    yield from group(pa.Table.from_batches(held))
                    held, rows = [], 0
                held.append(batch.slice(a, b - a))
                rows += b - a
        if held:
            yield from group(pa.Table.from_batches(held))

    return run


def _single_strings(buckets: int):
    """The strings of crowded anchors one by one: dealt by the hash of the string, and settled like contexts."""
    powers = [np.cumprod(np.full(LENGTH, base | 1, dtype=U64)) for base in (_BASE, _ROLL[0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict[str, np.ndarray]] = []
            for first in range(0, len(batch), 512):
                strings, _, doc, start = _suffixes_of(pa.Table.from_batches([batch.slice(first, 512)]))
                value = _BYTE[strings]
                none = np.zeros(len(doc), np.int64)
                held.append({"doc": doc, "lo": start, "span": none, "off": none, "gram": mix((value * powers[0]).sum(axis=1)), "context": mix((value * powers[1]).sum(axis=1))})
            if held:
                x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                ids, x["doc"] = np.unique(x["doc"], return_inverse=True)
                yield from _pack_found(x, ids, buckets)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed and kept bytes of each text."""
    known: tuple[list[dict], dict[str, np.ndarray]] | None = None
    for marks, texts in _with_texts(batches):
        if known is None or known[0] is not marks:
            known = (marks, _by_document(marks))
        x = known[1]
        rows: list[tuple] = []
        for r in texts:
            raw = (r["text"] or "").encode()
            n = len(raw)
            a, b = (0, 0) if r["doc_id"] is None or not x else np.searchsorted(x["doc"], [r["doc_id"], r["doc_id"] + 1])
            if a == b:
                rows.append((r["doc_id"], n, 0, [], raw))
                continue
            lo = x["lo"][a:b].astype(np.int64)
            end = lo + x["span"][a:b] + LENGTH
            inside = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
            rows.append((r["doc_id"], n, int(inside.sum()), edge.tolist(), np.frombuffer(raw, np.uint8)[~inside].tobytes()))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "edges", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, edges, kept.

    ``edges`` are begin and end of each maximal removed run, one after another; ``kept``
    has the remaining bytes. Strings are judged on the input; matches do not cross
    documents, overlapping copies inside a document count. Null text counts as empty;
    texts shorter than LENGTH bytes keep all. Rows with a null doc_id keep all and remove
    nothing. Rows that share a doc_id are one document as far as order goes: of equal
    strings at the same place in them, each stays. Empty table: no rows. Other columns are
    dropped.

    Sizes: a task holds the anchors of one bucket (the number of buckets follows the number of input
    splits). An anchor with more than HOT contexts deals its strings by their own hash instead.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(48, 2 * texts.rdd.getNumPartitions())
    found = texts.where("doc_id is not null and octet_length(text) >= 100").mapInArrow(released(_find(buckets)), _PACK)
    marks = cut_lineage(found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(buckets), _MARKS))

    rows = _document_bucket(texts, buckets).select("bucket", F.lit(2).cast("byte").alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("doc", "lo", "span", "off", "gram")], "doc_id", "text")

    def meet(part: DataFrame, those: DataFrame) -> DataFrame:
        both = part.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(those)
        return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    asked = rows.where("doc_id is not null and octet_length(text) >= 100")
    parts = cut_lineage(meet(marks.where("kind = 0"), asked).mapInArrow(_contexts, "gram long, doc long, lo long, off int, part binary"))
    crowded = small_side(cut_lineage(parts.groupBy("gram").count().where(F.col("count") > HOT).select("gram")))
    few = parts.join(crowded, "gram", "left_anti")
    factors = few.repartition(buckets, "gram").sortWithinPartitions("gram").select("gram", "doc", "lo", "off", "part").mapInArrow(released(_factor_marks(buckets)), _MARKS)
    every = marks.where("kind = 1").unionByName(factors)
    if crowded.limit(1).count():
        single = parts.join(crowded, "gram", "left_semi").select("gram", "doc", "lo", "off", "part").mapInArrow(_single_strings(buckets), _PACK)
        every = every.unionByName(single.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(buckets), _MARKS).where("kind = 1"))
    return meet(every, rows).mapInArrow(released(_cut), "doc_id long, n_bytes long, n_removed long, edges array<long>, kept binary")


def _document_bucket(texts: DataFrame, buckets: int) -> DataFrame:
    """Adds the bucket that _deal_marks gives to a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            bucket = (mix(ids.view(U64)) >> U64(48)).astype(np.int64) % buckets
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *batch.columns], names=["bucket", "doc_id", "text"])

    return texts.mapInArrow(run, "bucket int, doc_id long, text string")
