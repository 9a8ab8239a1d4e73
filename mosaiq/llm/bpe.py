"""Byte-level BPE: ranked merges folded over the distinct words of a block of texts, and decoding by joined pieces.

A block of documents becomes one row that holds its distinct words, the ranks of the tokens
that stand in each, and the word numbers of each document. A word is a string with one
character a part, so Spark's higher-order functions fold the merges by replacing two
characters by one; the ids are then dealt back to the documents of the row. Everything is
one narrow stage: no text or word is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mosaiq.llm.common import blocks, released, text_buffers

FOLD_BYTES = 192
"""Longer single words take the same merges from a heap, as a fold over them needs quadratic time."""

BLOCK_BYTES = 1 << 20
KNOWN_WORDS = 1_000_000
OUT_DOCS = 512
FIRST_PART, SURROGATES = 0x800, range(0xD800, 0xE000)
"""A part is written as one character: this one for number 0, the surrogates left out."""


def load_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _characters(parts: np.ndarray) -> np.ndarray:
    at = parts.astype(np.int64) + FIRST_PART
    return (at + len(SURROGATES) * (at >= SURROGATES.start)).astype("<u4")


def _parts(characters: np.ndarray) -> np.ndarray:
    at = characters.astype(np.int64)
    return at - FIRST_PART - len(SURROGATES) * (at >= SURROGATES.stop)


def byte_parts(ranks: dict[bytes, int]) -> np.ndarray:
    """Part of each byte: its rank, or a number beyond all ranks for a byte that has none."""
    beyond = max(ranks.values()) + 1
    return np.array([ranks.get(bytes([b]), beyond + b) for b in range(256)])


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "array<string>")


def merge_rules(ranks: dict[bytes, int]) -> tuple[list[str], list[str]]:
    """For each rank, the two parts that its merge joins, and the one it makes of them.

    The parts of a token are what the merges of lower rank make of it. By the time that
    a token's rank comes, its bytes are always those two parts: nothing has been merged
    across the token's ends, so what happened inside did not depend on the rest.
    """
    found, joined = [""] * (max(ranks.values()) + 1), [""] * (max(ranks.values()) + 1)
    sign = _characters(np.append(np.arange(len(found)), byte_parts(ranks))).tobytes().decode("utf-32-le")
    written = lambda p: sign[ranks[p] if p in ranks else len(found) + p[0]]
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) > 2:
            raise ValueError(f"the merges cannot make {token!r}")
        if len(parts) == 2:
            found[rank] = "".join(map(written, parts))
            joined[rank] = written(token)
    return found, joined


def encode_word(word: Column, ranks: Column, found: Column, joined: Column) -> Column:
    """``word`` with its parts merged, given as one character a byte and the sorted ranks of the tokens that stand in it.

    These ranks are the merges that can come about, and in a sound vocabulary merges come
    in the order of their ranks. So one fold over them does the work: each joins its pair
    wherever it stands, from left to right. A rank too many changes nothing.
    """
    return F.aggregate(ranks, word, lambda text, r: F.replace(text, F.get(found, r), F.get(joined, r)))


class Tokens:
    """The tokens of a vocabulary as a trie, its edges in a table of hashes: some 3 MB that go with a task, so that workers keep nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        edges: dict[int, int] = {}
        ends = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            ends[node] = rank
        self.longest = max(map(len, ranks))
        self.base = max(ranks.values()) + 1
        self.single = byte_parts(ranks)
        self.rank = np.full(len(edges) + 1, -1, dtype=np.int32)
        self.rank[list(ends)] = list(ends.values())
        bits = (2 * len(edges)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.key, self.node = np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        keys, nodes = np.array(list(edges), dtype=np.int64), np.array(list(edges.values()), dtype=np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.key[at] < 0
            self.key[at[free]] = keys[free]
            held = self.key[at] == keys
            self.node[at[held]] = nodes[held]
            keys, nodes, at = keys[~held], nodes[~held], (at[~held] + 1) & (len(self.key) - 1)
        byte = np.arange(256, dtype=np.int32)
        first = np.repeat(self.step(np.zeros(256, np.int32), byte), 256)
        self.second = np.where(first > 0, self.step(first, np.tile(byte, 256)), 0).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that each node's edge of that byte leads to, 0 if it has none."""
        keys = nodes << 8 | byte
        at = self._slot(keys)
        seen = self.key[at]
        hit = seen == keys
        out = self.node[at] * hit
        left = np.flatnonzero(~hit & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.key) - 1)
            seen = self.key[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.node[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out

    def inside(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of the tokens of two bytes and more in each word, sorted and distinct, as values and offsets; and the rank of each whole word or -1.

        Word k is ``data[at[k]:at[k + 1]]``. A word that is a token lists none.
        """
        n = len(at) - 1
        size = np.diff(at)
        whole = np.full(n, -1, dtype=np.int64)
        ones = np.flatnonzero(size == 1)
        whole[ones] = self.rank[self.step(np.zeros(len(ones), np.int32), data[at[ones]])]
        word = np.repeat(np.arange(n, dtype=np.int32), size)
        start = np.arange(len(data), dtype=np.int32)
        room = np.repeat(at[1:].astype(np.int32), size) - start
        live, found, length = np.flatnonzero(room > 1), [], 2
        pairs = data[start[live]].astype(np.int32) << 8 | data[start[live] + 1]
        node = self.second[pairs]
        while True:
            word, start, room = word[live], start[live], room[live]
            rank = self.rank[node]
            some = np.flatnonzero(rank >= 0)
            found.append(word[some].astype(np.int64) * self.base + rank[some])
            ends = some[room[some] == length]
            ends = ends[start[ends] == at[word[ends]]]
            whole[word[ends]] = rank[ends]
            length += 1
            live = np.flatnonzero((node > 0) & (room >= length))
            if not len(live):
                break
            node = self.step(node[live], data[start[live] + (length - 1)])
        both = np.concatenate(found)
        both = both[whole[both // self.base] < 0]
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        word, rank = np.divmod(both, self.base)
        return rank, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))]), whole


def _heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, with neighbours in linked lists and pairs in a heap."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _blocks(batch: pa.RecordBatch, block_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, ``block_bytes`` of text at a time: a block's distinct words are held at once."""
    _, at = text_buffers(batch.column(1))
    for first, last in blocks(at, block_bytes):
        yield batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_RANKS: dict[str, dict[bytes, int]] = {}


def _ranks(rank_file: str) -> dict[bytes, int]:
    if rank_file not in _RANKS:
        _RANKS[rank_file] = load_ranks(rank_file)
    return _RANKS[rank_file]


def _strings_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Strings of the characters ``data[at[k]:at[k + 1]]``, all from FIRST_PART on."""
    size = np.concatenate([[0], np.cumsum(3 + (data > 0xFFFF))])
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(size[at].astype(np.int32)), pa.py_buffer(data.tobytes().decode("utf-32-le").encode()))


def _words(new: list[str], tokens: Tokens, ranks_of: Callable[[], dict[bytes, int]]) -> tuple[pa.Array, pa.Array, list[list[int]]]:
    """Words as Spark folds them, the ranks inside each, and the ids of those too long for it (number, ids)."""
    data = np.frombuffer("".join(new).encode(), dtype=np.uint8)
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = begins[np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])]
    long = np.flatnonzero(np.diff(at) > FOLD_BYTES).tolist()
    long_ids = [[k, *_heap_merge(new[k].encode(), ranks_of())] for k in long]
    if long:
        size = np.diff(at)
        kept = np.repeat(size <= FOLD_BYTES, size)
        size[long] = 0
        data, at = data[kept], np.concatenate([[0], np.cumsum(size)])
    ranks, offsets, whole = tokens.inside(data, at)
    # a word that is a token is written as that one part
    size = np.where(whole >= 0, 1, np.diff(at))
    kept = np.ones(len(data), dtype=bool)
    first = at[:-1][whole >= 0]
    kept[np.repeat(whole >= 0, np.diff(at))] = False
    kept[first] = True
    parts = tokens.single[data]
    parts[first] = whole[whole >= 0]
    words = _strings_of(_characters(parts[kept]), np.concatenate([[0], np.cumsum(size)]))
    return words, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ranks.astype(np.int32))), long_ids


def pieces_of(rank_file: str) -> list[bytes]:
    """Bytes of each id (an id that the file lacks has none)."""
    ranks = _ranks(rank_file)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, summary: tuple[str, Callable[[list[list[int]]], list[pa.Array]]] | None = None, known_words: int = KNOWN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (array of int), for whole texts, without special tokens.

    ``summary`` (columns as DDL, a function from id sequences to these columns) returns
    what it makes of the ids in their place, in the task that has them. ``known_words``
    and ``block_bytes`` bound the memory of a task: beyond so many distinct words it starts to number anew, and
    so many bytes of text are numbered at once.

    Each match of ``pattern`` is encoded by itself. Null text counts as empty: no ids.
    Rows pass one by one: repeated rows, null ids and empty tables need no rule. Other
    columns are dropped.
    """
    ranks = load_ranks(rank_file)
    tokens, no_rank = Tokens(ranks), max(ranks.values()) + 1
    found, joined = (_strings(x) for x in merge_rules(ranks))
    del ranks
    out_schema = "doc_id long, " + (summary[0] if summary else "ids array<int>")
    out_names = [c.split()[0] for c in out_schema.split(", ")]
    block_schema = T.StructType([
        T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType())), T.StructField("merges", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("long_ids", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("known", T.IntegerType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        numbers = _Numbers()
        ranks_of = cache(lambda: load_ranks(rank_file))  # only long words need them
        for names, texts in (x for batch in batches for x in _blocks(batch, block_bytes)):
            # words of earlier blocks of the task are not folded again
            if len(numbers) > known_words:
                numbers.clear()
            known, parts, counts = len(numbers), [], []
            for text in texts:
                words = find(text.as_py() or "")
                counts.append(len(words))
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
            words, merges, long_ids = _words(list(islice(numbers, known, None)), tokens, ranks_of)
            all_of = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([
                pa.array([names.to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                pa.array([np.concatenate([np.zeros(0, np.int32), *parts]).tobytes()], pa.binary()),
                all_of(words), all_of(merges), pa.array([long_ids], pa.list_(pa.list_(pa.int32()))), pa.array([known], pa.int32()),
            ], names=block_schema.names)
            del words, merges, parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, begin, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                ids = batch.column(0)[row].values
                counts = np.asarray(batch.column(1)[row].values)
                numbers = np.frombuffer(batch.column(2)[row].as_py(), dtype=np.int32)
                folded = batch.column(3)[row].values
                data, at = text_buffers(folded) if len(folded) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
                data = data[at[0] : at[-1]]
                at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at - at[0]]
                made = _parts(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4"))
                if len(made) and made.max() >= no_rank:
                    raise ValueError(f"the vocabulary lacks byte {made.max() - no_rank}")
                if batch.column(5)[row].as_py() == 0:
                    flat, begin, size = flat[:0], begin[:0], size[:0]
                first_new = len(begin)
                begin, size = np.concatenate([begin, at[:-1] + len(flat)]), np.concatenate([size, np.diff(at)])
                flat = np.concatenate([flat, made.astype(flat.dtype)])
                for k, *own in batch.column(4)[row].as_py():
                    begin[first_new + k], size[first_new + k] = len(flat), len(own)
                    flat = np.concatenate([flat, np.array(own, flat.dtype)])
                edges = np.concatenate([[0], np.cumsum(counts)])
                for first in range(0, len(ids), OUT_DOCS):
                    last = min(first + OUT_DOCS, len(ids))
                    word = numbers[edges[first] : edges[last]]
                    n = size[word]
                    stop = np.concatenate([[0], np.cumsum(n)])
                    place = np.arange(stop[-1]) + np.repeat(begin[word] - stop[:-1], n)
                    offsets = stop[edges[first : last + 1] - edges[first]]
                    if summary:
                        made = flat[place].tolist()
                        yield pa.RecordBatch.from_arrays([ids[first:last], *summary[1]([made[a:b] for a, b in zip(offsets, offsets[1:])])], names=out_names)
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [ids[first:last], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[place].astype(np.int32)))], names=["doc_id", "ids"])

    words = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(cut), block_schema)
    def fold(tables: Column) -> Column:
        return F.transform("words", lambda w, k: encode_word(w, F.get("merges", k), tables["found"], tables["joined"]))

    # the tables are one literal, named once: every task unpacks what its plan holds
    tables = F.struct(found.alias("found"), joined.alias("joined"))
    folded = words.select("doc_ids", "counts", "numbers", F.get(F.transform(F.array(tables), fold), F.lit(0)).alias("ids"), "long_ids", "known")
    return folded.mapInArrow(released(deal), out_schema)


def join_pieces(ids: list[int], pieces: list[bytes]) -> bytes:
    """Bytes of one id sequence; an id beyond the vocabulary is an IndexError."""
    return b"".join(map(pieces.__getitem__, ids))


def decode(coded: DataFrame, rank_file: str) -> DataFrame:
    """coded(doc_id, ids) -> doc_id, ids, decoded: the pieces of the ids one after another. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(rank_file)
        for batch in batches:
            made = [None if x is None else join_pieces(x, pieces) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
