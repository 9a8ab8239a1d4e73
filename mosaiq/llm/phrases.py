"""Phrase mining per language: runs of words that recur and hang together more than their parts would by chance.

Words become numbers (infrequent ones breaks, as no frequent phrase holds one), texts
streams of numbers. Candidates grow word by word: only phrases whose first words are a frequent phrase,
and whose last word is frequent, are looked at. A trie goes to all tasks; numpy advances
the states of all positions of a stream at once, one word a step, and counts the accepting states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mosaiq.llm.common import LOWER, U64, mix, released, stored, text_buffers
from mosaiq.session import cut_lineage

LEAST, LONGEST, TOP = 100, 5, 2000
SPAN_BYTES = 1 << 20
"""Text hashed at once; a longer single word is a span of its own."""
SLICE_WORDS = 1 << 18
"""Positions of a stream whose states advance together."""
KEYS = 1 << 20
"""Candidate keys a task holds before it sums and sends them; a bucket is meant for the keys of four times as many words."""
VOCABULARY = 1 << 20
"""Words of a lookup table sent to all tasks; more words are looked up in several passes."""
PHRASES = 1 << 20
"""Phrases of a trie sent to all tasks; more phrases are dealt into several tries by their first two words, a pass over the streams for each."""

KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FACTOR = 0x9E3779B97F4A7C15
_STREAM = "ids binary"


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, _FACTOR, U64))
    return up, np.cumprod(np.full(n, pow(_FACTOR, -1, 1 << 64), U64))


def _spans(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of bytes of about SPAN_BYTES that end between two words."""
    lo, stop = int(at[0]), int(at[-1])
    while lo < stop:
        hi = min(lo + SPAN_BYTES, stop)
        edge = int(at[np.searchsorted(at, hi)])
        while hi < edge:
            gap = np.flatnonzero(KIND[data[hi : min(hi + 4096, edge)]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + 4096, edge)
            if len(gap):
                break
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a run of texts, span by span: place and length in bytes, hash, text number, and whether a piece begins."""
    broken, last_text = True, -1
    for lo, hi in _spans(data, at):
        part = data[lo:hi]
        kind = KIND[part]
        solid = kind == 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = at[np.searchsorted(at, lo, side="right") : np.searchsorted(at, hi)] - lo
        begins[inner] = solid[inner]
        starts = np.flatnonzero(begins)
        if not len(starts):
            broken |= bool((kind == 2).any())
            continue
        lengths = np.add.reduceat(solid, starts, dtype=np.int64)
        up, down = _powers(max(SPAN_BYTES, 1 << (len(part) - 1).bit_length()))
        # the sum of letters times powers, moved back to the beginning of the word
        value = np.cumsum((LOWER[part].astype(U64) + U64(1)) * up[: len(part)])
        ends = starts + lengths - 1
        value = (value[ends] - np.where(starts > 0, value[starts - 1], U64(0))) * down[starts]
        text = np.searchsorted(at, starts + lo, side="right") - 1
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        fresh = np.empty(len(starts), dtype=bool)
        fresh[0] = broken or text[0] != last_text or breaks[starts[0]] > 0
        fresh[1:] = (np.diff(breaks[starts]) > 0) | (np.diff(text) > 0)
        broken, last_text = bool(breaks[-1] > breaks[starts[-1]]), int(text[-1])
        yield starts + lo, lengths, mix(value + lengths.astype(U64)), text, fresh


def _langs(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, codes and salts of the languages of a batch."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    salts = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") for x in names], U64)
    return names, np.asarray(coded.indices), salts


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    letters = LOWER[data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each span with their counts, and the number of words of a language as that of the null word."""
    for batch in batches:
        names, code, salts = _langs(batch.column(0))
        data, at = text_buffers(batch.column(1))
        for starts, lengths, value, text, _ in split_words(data, at):
            lang = code[text]
            _, first, n = np.unique(mix(value ^ salts[lang]), return_index=True, return_counts=True)
            seen, total = np.unique(lang, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([names[k] for k in np.concatenate([lang[first], seen]).tolist()], pa.string()),
                pa.concat_arrays([_strings(data, starts[first], lengths[first]), pa.nulls(len(seen), pa.string())]),
                pa.array(np.concatenate([mix(value[first] ^ salts[lang[first]]), np.zeros(len(seen), U64)]).view(np.int64)),
                pa.array(np.concatenate([n, total]), pa.int64())], names=["lang", "word", "key", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Word keys of the texts in order, 0 before each piece."""
    for batch in batches:
        _, code, salts = _langs(batch.column(0))
        data, at = text_buffers(batch.column(1))
        for _, _, value, text, fresh in split_words(data, at):
            key = mix(value ^ salts[code[text]])
            yield np.insert(key, np.flatnonzero(fresh), U64(0))


class Table:
    """Numbers of words by their key: sorted keys, entered by their leading bits."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.shift = U64(64 - max(1, len(keys).bit_length() + 1))
        edges = np.arange(1 << (64 - int(self.shift)), dtype=U64) << self.shift
        self.first = np.searchsorted(self.keys, edges).astype(np.int32)
        self.run = int(np.diff(np.append(self.first, len(keys))).max())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[keys >> self.shift]
        out = np.zeros(len(keys), dtype=np.int32)
        for k in range(self.run):
            place = np.minimum(at + k, len(self.keys) - 1)
            out += np.where((self.keys[place] == keys) & (at + k < len(self.keys)), self.ids[place], 0)
        return out


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Each run of breaks as one."""
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep]


def _number_texts(table: Table):
    """Streams of word numbers; a row ends at a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys in _hashed(batches):
            held.append(_squeezed(table(keys)))
            size += len(held[-1])
            if size < SLICE_WORDS:
                continue
            ids = np.concatenate(held)
            gaps = np.flatnonzero(ids == 0)
            if len(gaps):
                yield _binary_batch(ids=ids[: gaps[-1]])
                held, size = [ids[gaps[-1] :]], len(ids) - int(gaps[-1])
            else:
                held = [ids]
        if size:
            yield _binary_batch(ids=np.concatenate(held))

    return run


def _binary_batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns.values()], names=list(columns))


def _keep_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys in _hashed(batches):
        yield _binary_batch(keys=keys, ids=np.zeros(len(keys), np.int32))


def _look_up_more(table: Table):
    """One more part of the vocabulary for streams that still carry their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _binary_batch(keys=np.frombuffer(keys, U64), ids=np.frombuffer(ids, np.int32) + table(np.frombuffer(keys, U64)))

    return run


class Trie:
    """Phrases (rows of numbers, filled up with 0) as nodes numbered by depth; a node and a code find the child in the bucket of their hash.

    A bucket has one edge or so. Edges are placed by one sort, so a trie of a million phrases takes seconds.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases = phrases[np.lexsort(phrases.T[::-1])]
        depth, self.size = phrases.shape[1], len(phrases)
        self.alphabet = np.unique(phrases[phrases > 0])
        codes = np.where(phrases > 0, np.searchsorted(self.alphabet, phrases) + 1, 0)
        # nodes by depth, siblings together in the order of their codes; node 0 is the root
        parent, symbol, accept = [np.array([-1])], [np.array([0])], [np.array([-1])]
        above, nodes = np.zeros(len(phrases), np.int64), 1
        lengths = (phrases > 0).sum(axis=1)
        changed = np.zeros(len(phrases), dtype=bool)
        changed[:1] = True
        for d in range(depth):
            changed[1:] |= codes[1:, d] != codes[:-1, d]
            new = changed & (codes[:, d] > 0)
            node = nodes + np.cumsum(new) - 1
            parent.append(above[new])
            symbol.append(codes[new, d])
            ends = np.full(int(new.sum()), -1)
            done = np.flatnonzero(lengths == d + 1)
            ends[node[done] - nodes] = done
            accept.append(ends)
            above, nodes = node, nodes + int(new.sum())
        parent, symbol, accept = (np.concatenate(x) for x in (parent, symbol, accept))
        self.accept = accept.astype(np.int32)
        self.root = np.zeros(len(self.alphabet) + 1, np.int32)
        first = np.flatnonzero(parent == 0)
        self.root[symbol[first]] = first
        below = np.flatnonzero(parent > 0)
        keys = self._keys(parent[below], symbol[below])
        self.shift = U64(64 - max(1, len(below).bit_length()))
        bucket = self._bucket(keys)
        order = np.argsort(bucket)
        self.edges, self.child = keys[order], below[order].astype(np.int32)
        self.begin = np.zeros((1 << (64 - int(self.shift))) + 1, np.int32)
        np.cumsum(np.bincount(bucket, minlength=len(self.begin) - 1), out=self.begin[1:])

    def __getstate__(self) -> dict:
        """What tasks need: not the phrases, nor what they make themselves."""
        return {k: v for k, v in self.__dict__.items() if k not in ("phrases", "_dense")}

    @staticmethod
    def _keys(state: np.ndarray, code: np.ndarray) -> np.ndarray:
        return state.astype(U64) << U64(32) | code.astype(U64)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        keys = (keys ^ keys >> U64(29)) * U64(_FACTOR)
        return ((keys ^ keys >> U64(32)) * U64(_FACTOR) >> self.shift).astype(np.int64)

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children, 0 where there is none."""
        child = np.zeros(len(state), np.int32)
        mine = np.flatnonzero(code)
        keys = self._keys(state[mine], code[mine])
        bucket = self._bucket(keys)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        while True:
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                return child
            mine, keys, at, end = mine[open_], keys[open_], at[open_], end[open_]
            hit = self.edges[at] == keys
            child[mine[hit]] = self.child[at[hit]]
            at += 1
            at[hit] = end[hit]

    def walk(self, ids: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words up to ``depth``: the positions at which a phrase so long begins, and their states."""
        # breaks and strange words get code 0, which leads nowhere
        at = np.minimum(np.searchsorted(self.alphabet, ids), len(self.alphabet) - 1) if self.dense is None else None
        code = np.where(self.alphabet[at] == ids, at + 1, 0) if at is not None else self.dense[ids]
        code = np.concatenate([code.astype(np.int32), np.zeros(depth, np.int32)])
        place, state = np.arange(len(ids)), np.zeros(len(ids), np.int32)
        for d in range(depth):
            child = self._step(state, code[place + d]) if d else self.root[code[place]]
            alive = np.flatnonzero(child)
            place, state = place[alive], child[alive]
            yield d + 1, place, state

    @property
    def dense(self) -> np.ndarray | None:
        """Codes by word number, if these are few enough for a table."""
        if "_dense" not in self.__dict__:
            self._dense = None
            if self.limit <= 4 * VOCABULARY:
                self._dense = np.zeros(self.limit + 1, np.int32)
                self._dense[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self._dense

    limit = 1 << 62
    """The largest word number of the streams."""


def _slices(batches: Iterator[pa.RecordBatch], halo: int) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of the streams with ``halo`` more words than the positions that count."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            ids = np.frombuffer(raw, np.int32)
            for a in range(0, len(ids), SLICE_WORDS):
                yield ids[a : a + SLICE_WORDS + halo], min(SLICE_WORDS, len(ids) - a)


def _candidates(trie: Trie | None, words: int, buckets: int):
    """Phrases of ``words`` words seen, as keys (number of the first words, last word) with their counts up to 255, by bucket.

    Phrases of two words need no trie: the first word's number is the state.
    """

    def sums(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (mix(keys) % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            yield pa.RecordBatch.from_arrays([
                pa.array([bucket[part[0]]], pa.int32()), pa.array([keys[part].tobytes()], pa.binary()),
                pa.array([np.minimum(n[part], 255).astype(np.uint8).tobytes()], pa.binary())], names=["bucket", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, own in _slices(batches, words):
            if trie is None:
                place = np.flatnonzero(ids[:own])
                number = ids[place]
            else:
                for _, place, state in trie.walk(ids, words - 1):
                    pass
                place, number = place[place < own], trie.accept[state[place < own]]
            last = np.append(ids, np.zeros(words, np.int32))[place + words - 1]
            keys = (number.astype(U64) << U64(32) | last.astype(U64))[last > 0]
            held.append(keys)
            size += len(keys)
            if size >= KEYS:
                yield from sums(held)
                held, size = [], 0
        if size:
            yield from sums(held)

    return run


def _frequent(prefixes: np.ndarray | None, least: int):
    """Phrases of a bucket seen at least ``least`` times. Counts up to 255 are enough to tell."""

    def settle(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, which = np.unique(np.concatenate([np.frombuffer(k, U64) for k, _ in rows]), return_inverse=True)
        keys = keys[np.bincount(which, np.concatenate([np.frombuffer(n, np.uint8) for _, n in rows])) >= least]
        number, last = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int32)
        first = number[:, None].astype(np.int32) if prefixes is None else prefixes[number]
        words = np.concatenate([first, last[:, None]], axis=1)
        offsets = np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel()))], names=["w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for bucket, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                if held and bucket != of:
                    yield settle(held)
                    held = []
                of = bucket
                held.append((keys, n))
        if held:
            yield settle(held)

    return run


RANGE = 1 << 16
"""Phrase numbers whose counts travel and are added up together."""


def _tally(trie: Trie, depth: int):
    """Accepting states of a task's streams as vectors of counts by phrase number, one for each range of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(trie.accept), np.int64)
        for ids, own in _slices(batches, depth):
            for d, place, state in trie.walk(ids, depth):
                if d > 1:
                    total += np.bincount(state[place < own], minlength=len(total))
        states = np.flatnonzero(trie.accept >= 0)
        counts = np.zeros(trie.size, np.int64)
        counts[trie.accept[states]] = total[states]
        for a in range(0, len(counts), RANGE):
            part = counts[a : a + RANGE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([a // RANGE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "counts"])

    return run


def _add_up(phrases: np.ndarray):
    """Sums of the vectors of a range, one after the other, with the words of its phrases."""

    def named(part: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = phrases[part * RANGE : (part + 1) * RANGE]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[r > 0] for r in rows[a : a + 10_000]], pa.list_(pa.int32())), pa.array(total[a : a + 10_000])], names=["w", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, None
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if part != of:
                    if of is not None:
                        yield from named(of, total)
                    of, total = part, np.zeros(len(raw) // 8, np.int64)
                total += np.frombuffer(raw, np.int64)
        if of is not None:
            yield from named(of, total)

    return run


def _tries(phrases: DataFrame, depth: int, limit: int) -> Iterator[Trie]:
    """Tries of at most some PHRASES phrases each, dealt by their first two words."""
    parts = -(-phrases.count() // PHRASES)
    for part in range(parts):
        rows = phrases.where(F.pmod(F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.lit(parts)) == part).select("w").toArrow().column(0).combine_chunks()
        if not len(rows):
            continue
        size = np.diff(np.asarray(rows.offsets))
        table = np.zeros((len(rows), depth), np.int32)
        table[np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(rows.flatten())
        trie = Trie(table)
        trie.limit = limit
        yield trie


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(lang, text) -> words(id, lang, word, n), totals(lang, n) and phrases(w: word ids, a).

    Words and phrases of 2 to ``longest`` words that occur at least ``least`` times in their language; ``a`` counts all occurrences
    inside pieces, overlapping ones included. Null lang is ``und``, null text empty.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    counted = texts.mapInArrow(released(_count_words), "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", "n")
    size = counted.where("word is not null").count()
    parts = max(1, -(-size // VOCABULARY))
    part = F.pmod("key", F.lit(parts))
    sizes = {r[0]: r[1] for r in counted.where("word is not null").groupBy(part.alias("part")).count().collect()}
    offsets = np.cumsum([0, *(sizes.get(p, 0) for p in range(parts))]).tolist()
    order = Window.partitionBy(part).orderBy("key", "lang", "word")
    words = counted.where("word is not null").withColumn("id", (F.row_number().over(order) + F.get(F.array(*map(F.lit, offsets)), part.cast("int"))).cast("int"))
    words = cut_lineage(words.select("id", "lang", "word", "key", "n"))

    def table(p: int) -> Table:
        got = words.where(part == p).select("key", "id").toArrow()
        return Table(got.column(0).to_numpy().view(U64), got.column(1).to_numpy())

    if not size:
        return words, totals, spark.createDataFrame([], "w array<int>, a long")
    if parts == 1:
        streams = stored(texts.mapInArrow(released(_number_texts(table(0))), _STREAM))
    else:
        streams = stored(texts.mapInArrow(released(_keep_keys), "keys binary, ids binary"))
        for p in range(parts):
            if sizes.get(p):
                streams = stored(streams.mapInArrow(released(_look_up_more(table(p))), "keys binary, ids binary"))
        streams = streams.select("ids")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals.agg(F.sum("n")).first()[0]) // (4 * KEYS)))
    levels: list[DataFrame] = []
    for length in range(2, longest + 1):
        grown = []
        for trie in [None] if length == 2 else _tries(levels[-1], length - 1, size):
            seen = streams.mapInArrow(released(_candidates(trie, length, buckets)), "bucket int, keys binary, n binary")
            dealt = seen.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            grown.append(cut_lineage(dealt.mapInArrow(released(_frequent(None if trie is None else trie.phrases, least)), "w array<int>")))
        if not grown or not any(g.limit(1).count() for g in grown):
            break
        whole = grown[0]
        for more in grown[1:]:
            whole = whole.unionByName(more)
        levels.append(whole)
    phrases = None
    if levels:
        whole = levels[0]
        for more in levels[1:]:
            whole = whole.unionByName(more)
        for trie in _tries(whole, longest, size):
            shards = streams.mapInArrow(released(_tally(trie, longest)), "part int, counts binary")
            dealt = shards.repartition(-(-len(trie.phrases) // RANGE), "part").sortWithinPartitions("part")
            found = cut_lineage(dealt.mapInArrow(released(_add_up(trie.phrases)), "w array<int>, a long"))
            phrases = found if phrases is None else phrases.unionByName(found)
    return words, totals, phrases if phrases is not None else spark.createDataFrame([], "w array<int>, a long")


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    A-Z become lower case; texts are pieces between ``.,;:!?`` and line ends, pieces are words between
    blanks and tabs. Candidates are phrases of 2 to ``longest`` words that occur a >= ``least`` times within pieces. n counts
    the words of the language. A cut gives l and r, the counts of both sides, and the score floor(1000 a n / (l r)); the cut of
    the smallest score counts, of equal ones the first. A candidate inside a longer one that occurs
    as often is dropped. Order: score and a descending, then the phrase.

    Null lang: ``und``, together with rows that say so. Null, empty and wordless texts add nothing; repeated rows count
    each. Empty table: no rows. Other columns are ignored.
    """
    words, totals, phrases = count_phrases(docs, least, longest)
    sub = F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)")))
    longer = phrases.where(F.size("w") > 2).select(sub.alias("w"), F.col("a").alias("whole")).groupBy("w").agg(F.max("whole").alias("whole"))
    kept = phrases.join(longer, "w", "left").where("whole is null or whole < a").select("w", "a")
    counts = phrases.unionByName(words.select(F.array("id").alias("w"), F.col("n").alias("a")))
    cuts = kept.select("w", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("w", "a", "k", F.expr("slice(w, 1, k)").alias("left"), F.expr("slice(w, k + 1, size(w) - k)").alias("right"))
    of_lang = words.join(totals.withColumnRenamed("n", "all"), "lang").select(F.col("id").alias("first"), "lang", F.col("all").alias("n"))
    cuts = (
        cuts.join(counts.select(F.col("w").alias("left"), F.col("a").alias("l")), "left")
        .join(counts.select(F.col("w").alias("right"), F.col("a").alias("r")), "right")
        .withColumn("first", F.get("w", F.lit(0))).join(of_lang, "first")
    )
    # exact: 38 digits hold any product of two counts and 1000
    score = F.expr("(1000 * cast(a as decimal(18, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cuts.groupBy("w", "a", "lang", "n").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    best = best.select("w", "lang", "a", "cut.l", "cut.r", "n", "cut.score")
    spelt = (
        best.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "word"), "id")
        .groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelt, "w").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
