"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win.

For each language a suffix automaton of a bounded labelled sample is built on the
workers. A text is parsed greedily into longest matches against each automaton; the
phrase count, times the bits that name a place in the sample, over the bytes read is an
entropy estimate, and the language with the lowest one is the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from mosaiq.llm.common import blocks, released, text_buffers

UNKNOWN = "und"
SAMPLE_DOCS = 64
SAMPLE_BYTES = 512
"""The fitted sample is bounded: so many documents of each language, one excerpt of so many bytes of each."""

SEGMENT = 256
"""Texts are parsed in segments of so many bytes, all segments of a block in step."""

_LATIN = 0xC3  # first byte of letters whose capitals are 0x20 below, as in ASCII
_PLAIN = np.full(256, 0x20, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def plain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (ASCII and Latin ones in lower case) and other bytes beyond ASCII; every other run is one space. Offsets follow."""
    lo, hi = int(at[0]), int(at[-1])
    part = _PLAIN[data[lo:hi]]
    second = np.flatnonzero(part[:-1] == _LATIN) + 1
    capital = second[(part[second] >= 0x80) & (part[second] < 0x9F) & (part[second] != 0x97)]
    part[capital] += 0x20
    keep = part != 0x20
    keep[1:] |= part[:-1] != 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])
    return part[keep], kept[at - lo]


class Automaton:
    """Suffix automaton of ``sample`` as one flat table: next state * 4 + phrases that end on the way.

    Where a state has no edge for a symbol, the phrase ends and the symbol begins the
    next one; a symbol that the sample lacks is a phrase by itself. Symbol ``pad``
    stays in place and costs nothing.
    """

    def __init__(self, sample: bytes):
        seen = sorted(set(sample))
        self.classes = np.full(257, len(seen), dtype=np.int64)
        for k, b in enumerate(seen):
            self.classes[b] = k
        self.width = len(seen) + 2
        self.classes[256] = self.pad = len(seen) + 1
        edges, link, length, last = [{}], [-1], [0], 0
        for c in self.classes[np.frombuffer(sample, dtype=np.uint8)].tolist():
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        table = np.full((len(edges), self.width), -1, dtype=np.int32)
        rows = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        table[rows, [c for e in edges for c in e]] = [4 * t for e in edges for t in e.values()]
        again = np.where(table[0] >= 0, table[0] + 1, 2).astype(np.int32)
        again[len(seen)] = 2
        table = np.where(table >= 0, table, again)
        table[0] = np.where(table[0] % 4 == 2, 1, table[0])
        table[:, self.pad] = 4 * np.arange(len(edges))
        self.table = np.ascontiguousarray(table).reshape(-1)
        self.bits = math.log2(len(sample) + 2)

    def phrases(self, segments: np.ndarray) -> np.ndarray:
        """Phrases of each column of ``segments`` (values 0-255, 256 where a segment is over)."""
        state = np.zeros(segments.shape[1], dtype=np.int64)
        found = np.zeros(segments.shape[1], dtype=np.int64)
        symbols = self.classes[segments]
        for row in symbols:
            step = self.table[state * self.width + row]
            found += step & 3
            state = (step >> 2).astype(np.int64)
        return found + (state != 0)


def score_texts(column: pa.Array, models: dict[str, Automaton]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, confidence and bits per byte of each text (the caller knows which have letters)."""
    data, at = text_buffers(column)
    names = sorted(models)
    tools = [models[k] for k in names]
    best = np.zeros(len(at) - 1, dtype=np.int64)
    sure, rate = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for first, last in blocks(at):
        text, where = plain(data, at[first : last + 1])
        n = np.diff(where)
        pieces = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = where[owner] + nth * SEGMENT
        place = begin + np.arange(SEGMENT)[:, None]
        text = np.append(text, np.uint8(0)).astype(np.int16)
        segments = np.where(place < where[owner + 1], text[np.minimum(place, len(text) - 1)], np.int16(256))
        costs = np.array([np.bincount(owner, t.phrases(segments), minlength=len(n)) * t.bits / np.maximum(n, 1) for t in tools])
        order = np.argsort(costs, axis=0, kind="stable")
        low = np.take_along_axis(costs, order[:1], 0)[0]
        next_low = np.take_along_axis(costs, order[1:2], 0)[0] if len(tools) > 1 else np.full(len(n), np.inf)
        best[first:last], rate[first:last] = order[0], low
        sure[first:last] = np.where(next_low > 0, 1 - low / np.where(next_low > 0, next_low, 1), 0)
    return [names[k] for k in best], np.clip(sure, 0, 1), rate


def held_out() -> F.Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Sample text per language, at most ``sample_docs * sample_bytes`` bytes of each, from rows that are not held out.

    The documents of a language with the smallest id hashes are taken, and of each one
    excerpt at a place that the hash gives.
    """
    mark = F.xxhash64("doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(mark, "doc_id"))
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = usable.select("lang", "doc_id", rank.alias("_rank")).where(F.col("_rank") <= sample_docs).select("lang", "doc_id").distinct()
    start = F.pmod(mark, F.greatest(F.length("text") - sample_bytes + 1, F.lit(1))).cast("int") + 1
    excerpt = F.substring(F.col("text"), start, F.lit(sample_bytes))
    rows = (
        usable.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most sample_docs rows of each language
        .groupBy("lang", "doc_id").agg(F.min(excerpt).alias("excerpt")).collect()
    )
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        parts.setdefault(r.lang, []).append(r.excerpt)
    models = {}
    for lang, texts in parts.items():
        raw = np.frombuffer(" ".join(texts).encode(), dtype=np.uint8)
        models[lang] = plain(raw, np.array([0, len(raw)]))[0].tobytes()[: sample_docs * sample_bytes]
    return {k: v for k, v in models.items() if v.strip()}


def identify(docs: DataFrame, models: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score (1 - best / second-best entropy) and bits_per_byte; columns of these names are replaced.

    Reads only ``text``, all of it. Null text or text without a letter, and every text if
    nothing was learned: ``und``, score 0. Equal entropies go to the first language by
    name. Rows pass one by one, so repeated rows, null ids and empty tables need no rule.
    """
    names = ("lang_pred", "score", "bits_per_byte")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    # letters are looked for on the JVM
    lettered = "_lettered"
    while lettered in map(str.lower, kept.columns):
        lettered += "_"
    sent = kept.withColumn(lettered, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    place = [c.lower() for c in kept.columns].index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # built once a task and gone with it: Spark keeps the worker for other stages
        tools: dict[str, Automaton] = {}
        for batch in batches:
            if not tools:
                tools = {name: Automaton(sample) for name, sample in models.items()}
            k = batch.schema.get_field_index(lettered)
            column = batch.column(place)
            has = np.asarray(batch.column(k).fill_null(False)).astype(bool) & bool(models)
            pred, sure, rate = score_texts(column, tools) if tools else ([UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column)))
            pred = [p if h else UNKNOWN for p, h in zip(pred, has)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], *batch.columns[k + 1:], pa.array(pred, pa.string()), pa.array(np.where(has, sure, 0.0)), pa.array(np.where(has, rate, 0.0))],
                names=[f.name for f in schema.fields],
            )

    return sent.mapInArrow(released(run), schema)
