"""Language-model scores: stupid backoff from n-gram counts of the whole corpus, joined back and summed per document.

Documents are dealt into chunks. A chunk explodes its texts into words and word pairs and
sends each distinct one with its count to the bucket of its hash, where the count table of
that bucket is summed; the joined counts go back to the chunks that asked, where they are
looked up for every word and summed per document. The distinct n-grams of a chunk travel
packed, so the traffic is a few bytes for each, and no bucket or chunk is more than a
fixed share of the input, however often one word occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.common import U64, blocks, gram_hashes, mix, released, text_buffers, word_hashes
from mosaiq.session import cut_lineage

BACKOFF = 0.4
SEEN = 2
"""A pair counts as seen if the corpus has it so often; a single occurrence tells nothing about itself."""

CHUNK_BYTES = 12 << 20
"""Text that a chunk is meant for; its distinct n-grams are in memory at once."""

_WORD_SALT, _CHUNK_SALT = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def _distinct(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of ``bits`` bits in order, and which of them each key is; by leading bits, a sixteenth of the keys at a time."""
    which, found, size = np.empty(len(keys), np.int32), [keys[:0]], 0
    lead = (keys >> U64(bits - 4)).astype(np.uint8)
    for part in range(16):
        mine = np.flatnonzero(lead == part)
        some, at = np.unique(keys[mine], return_inverse=True)
        which[mine] = at + size
        found.append(some)
        size += len(some)
    return np.concatenate(found), which


def _ngrams(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Keys of the words and pairs of a chunk, the distinct keys with counts, and which distinct key each occurrence has."""
    parts = [word_hashes(data, at[a : b + 1]) for a, b in blocks(at)]
    words, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    del parts
    ends = np.cumsum(counts)
    inside = np.ones(max(len(words) - 1, 0), dtype=bool)
    edges = ends[:-1]
    inside[edges[(edges > 0) & (edges < len(words))] - 1] = False
    every = np.empty(len(words) + int(inside.sum()), U64)
    every[: len(words)] = mix(words ^ _WORD_SALT)
    every[len(words) :] = gram_hashes(words, 2)[inside]
    size = len(words)
    del words, inside
    keys, which = _distinct(every)
    del every
    n = np.bincount(which, minlength=len(keys))
    first = np.zeros(size, dtype=bool)
    first[(ends - counts)[counts > 0]] = True
    return {"keys": keys, "n": n, "word": which[:size], "pair": which[size:], "first": first, "counts": counts}


def _places(keys: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each bucket, the positions of its keys with count 1 and of the others; the same for the same texts."""
    bucket = (keys >> U64(48)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cut)):
        mine = order[cut[b] : cut[b + 1]]
        out.append((int(b), mine[n[mine] == 1], mine[n[mine] > 1]))
    return out


def _six(keys: np.ndarray) -> bytes:
    """The low six bytes of each key; the bucket has the rest of what tells keys apart."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _pack_texts(chunks: int):
    """Texts of a task by chunk, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            missing = np.asarray(batch.column(0).is_null()).astype(np.uint8)
            # rows without an id are dealt by the size of their text
            named = np.where(missing == 1, np.diff(at), ids)
            chunk = (mix(named.view(U64) ^ _CHUNK_SALT) >> U64(40)).astype(np.int64) % chunks
            for c in np.unique(chunk):
                rows = np.flatnonzero(chunk == c)
                text = b"".join(data[at[r] : at[r + 1]].tobytes() for r in rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([c], pa.int32()), pa.array([1], pa.int8()), pa.array([0], pa.int32()), pa.array([squeeze.compress(text)], pa.binary()),
                    pa.array([(at[rows + 1] - at[rows]).astype(np.int64).tobytes()], pa.binary()), pa.array([ids[rows].tobytes()], pa.binary()), pa.array([missing[rows].tobytes()], pa.binary())],
                    names=["chunk", "kind", "bucket", "body", "sizes", "ids", "missing"])

    return run


_PACKED = "chunk int, kind byte, bucket int, body binary, sizes binary, ids binary, missing binary"


def _chunk(rows: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    # parts come in any order: the distinct keys and their counts do not depend on it
    raw = [(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["missing"], np.uint8), zstandard.decompress(r["body"]) if len(r["body"]) else b"") for r in rows]
    sizes, ids, missing = (np.concatenate([x[k] for x in raw]) for k in (0, 1, 2))
    data = np.frombuffer(b"".join(x[3] for x in raw), np.uint8)
    return _ngrams(data, np.concatenate([[0], np.cumsum(sizes)])), ids, missing


def _runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches, "chunk"):
            x, _, _ = _chunk(rows)
            for b, single, more in _places(x["keys"], x["n"], buckets):
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[0]["chunk"]], pa.int32()), pa.array([b], pa.int32()), pa.array([_six(x["keys"][single])], pa.binary()),
                    pa.array([_six(x["keys"][more])], pa.binary()), pa.array([x["n"][more].astype(np.uint32).tobytes()], pa.binary())],
                    names=["chunk", "bucket", "single", "more", "n"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of one bucket's n-grams, sent back to every chunk in the order it asked."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for rows in _runs_of(batches, "bucket"):
        stop = np.cumsum([0, *((len(r["single"]) + len(r["more"])) // 6 for r in rows)])
        keys, n = np.empty(stop[-1], U64), np.ones(stop[-1], np.uint32)
        for r, a, b in zip(rows, stop, stop[1:]):
            single = len(r["single"]) // 6
            keys[a : a + single], keys[a + single : b] = _from_six(r.pop("single")), _from_six(r.pop("more"))
            n[a + single : b] = np.frombuffer(r.pop("n"), np.uint32)
        distinct, which = _distinct(keys, 48)
        del keys
        total = np.bincount(which, n, len(distinct)).astype(np.int64)
        del distinct, n
        for r, a, b in zip(rows, stop, stop[1:]):
            yield pa.RecordBatch.from_arrays([
                pa.array([r["chunk"]], pa.int32()), pa.array([0], pa.int8()), pa.array([r["bucket"]], pa.int32()), pa.array([squeeze.compress(total[which[a:b]].tobytes())], pa.binary()),
                *(pa.array([b""], pa.binary()) for _ in range(3))], names=["chunk", "kind", "bucket", "body", "sizes", "ids", "missing"])


def _score(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches, "chunk"):
            x, ids, missing = _chunk([r for r in rows if r["kind"] == 1])
            told = {r["bucket"]: r["body"] for r in rows if r["kind"] == 0}
            total = np.zeros(len(x["keys"]), dtype=np.int64)
            for b, single, more in _places(x["keys"], x["n"], buckets):
                total[np.concatenate([single, more])] = np.frombuffer(zstandard.decompress(told[b]), np.int64)
            word = total[x["word"]]
            follows = np.flatnonzero(~x["first"])
            pair = total[x["pair"]]
            seen = np.zeros(len(word), dtype=bool)
            seen[follows] = pair >= SEEN
            gain = np.log(np.maximum(word, 1))
            gain[follows] = np.where(pair >= SEEN, np.log(np.maximum(pair, 1)) - np.log(np.maximum(word[follows - 1], 1)), gain[follows])
            owner = np.repeat(np.arange(len(ids)), x["counts"])
            part = lambda v: np.bincount(owner, v, minlength=len(ids)).astype(np.float64)
            back = ~seen & ~x["first"]
            for a in range(0, len(ids), 10_000):
                s = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[s], mask=missing[s].astype(bool)), pa.array(x["counts"][s]), pa.array(part(gain)[s]),
                    pa.array(part(~seen)[s].astype(np.int64)), pa.array(part(back)[s].astype(np.int64))],
                    names=["doc_id", "n_words", "gain", "n_single", "n_backoff"])

    return run


def backoff_scores(docs: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_backoff, log_score, per_word.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. A word's score is
    count(previous, word) / count(previous) if the corpus has that pair at least SEEN
    times, else ``backoff`` * count(word) / all words; a document's first word has
    count(word) / all words. ``log_score`` is the sum of natural logarithms, ``per_word``
    its mean (null without words). Counts are over all rows of ``docs``, repeated rows
    included. Null or wordless text: 0 words, log_score 0. Null doc_id: scored, id null.
    Empty table: no rows. Other columns are dropped.

    Keys are hashes of 54 bits or more (six bytes and the bucket).
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(16, 2 * texts.rdd.getNumPartitions(), -(-size // CHUNK_BYTES))
    buckets = max(48, chunks)

    def dealt(df: DataFrame, n: int, by: str) -> DataFrame:
        # one number a task: a hash of it would give some tasks several and most none
        return df.repartitionById(n, by).sortWithinPartitions(by)

    packed = texts.mapInArrow(_pack_texts(chunks), _PACKED)
    asked = dealt(packed, chunks, "chunk").mapInArrow(released(_ask(buckets)), "chunk int, bucket int, single binary, more binary, n binary")
    answers = dealt(asked, buckets, "bucket").mapInArrow(released(_answer), _PACKED)
    both = dealt(packed.unionByName(answers), chunks, "chunk")
    scored = cut_lineage(both.mapInArrow(released(_score(buckets)), "doc_id long, n_words long, gain double, n_single long, n_backoff long"))
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.col("gain") - F.col("n_single") * math.log(total) + F.col("n_backoff") * math.log(backoff)
    return scored.select("doc_id", "n_words", "n_backoff", log_score.alias("log_score"),
                         F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("per_word"))
