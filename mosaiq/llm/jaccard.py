"""N-gram Jaccard join by partition signatures (PartEnum), exact, with connected components.

Sets whose Jaccard similarity is at least 3/4 have sizes a <= b <= 4a/3 and differ in at
most (a + b) / 7 features. Sizes fall into bands, each a third wider than it begins, so
partners are in the same or the next band. For a band of largest size h the feature domain
is cut by hash into more partitions than the 2h/7 features in which partners may differ:
they agree on at least one partition, and each partition that a set touches gives one
signature (the enumerated subsets have one partition each). Two refinements keep chance
groups small and lose no pair:

* features that a large share of all documents has are left out of the domain; a set that
  then touches too few partitions to be sure of a common one ("weak") also signs on the
  whole domain, under another salt, and, if even that is too few, signs its empty partitions;
* a set below TINY features signs by single features: of the first floor(a/4) + 1 by hash,
  partners share one.

Equal sets are one vertex, so copies cost nothing. Signature groups give candidate pairs
as stars around a few centres; pairs are checked on the whole sets; only where a group's
members are still in different components the remaining pairs between components follow.
Before whole sets travel, parity sketches (a bit for each of some places, flipped by every
feature that falls there) tell how many features differ at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.common import U64, blocks, components, gram_hashes, mix, released, small_side, stored, text_buffers, word_hashes
from mosaiq.session import cut_lineage

WORDS = 5
TINY = 24
COMMON = 512
"""A feature that more than one document in so many has is left out of the domain."""

FEATURES_A_BUCKET = 2_000_000
CENTRES, CROWD = 2, 8
"""A group of CROWD members or more has one of so many centres, by its name; smaller groups have the same one."""

FEATURE_BYTES = 6
"""Bytes of each feature that are sent for checking a pair."""

FLUSH = 600_000
SLICE = 200_000
BLOCK = 256
"""Members of an open group that are compared in one piece; larger groups are compared block by block, by several tasks."""

SALT_FULL, SALT_TINY, SALT_EMPTY = (U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def feature_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin (n + 1 offsets)."""
    words, counts = word_hashes(data, at)
    ends = np.cumsum(counts)
    begins = ends - counts
    n = len(counts)
    grams = gram_hashes(words, WORDS)
    per = np.maximum(counts - WORDS + 1, 0)
    owner = np.repeat(np.arange(n), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + begins[owner]
    features = grams[place] if len(place) else np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        own = np.zeros(len(short), U64)
        for k in range(WORDS - 1):
            has = counts[short] > k
            own[has] = mix(own[has] * U64(0x9FB21C651E98DF25) + words[begins[short[has]] + k] + U64(k + 1))
        owner, features = np.concatenate([owner, short]), np.concatenate([features, own])
    order = np.lexsort((features, owner))
    owner, features = owner[order], features[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (features[1:] != features[:-1])
    owner, features = owner[keep], features[keep]
    return features, np.searchsorted(owner, np.arange(n + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Wrapping sum of each run."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[at[1:]] - total[at[:-1]]


def set_ids(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal sets have equal names."""
    return mix(_sums(mix(features ^ U64(0x2545F4914F6CDD1D)), at) + np.diff(at).astype(U64))


def bands(largest: int) -> np.ndarray:
    """Largest size of each band: from lo to floor(4 lo / 3)."""
    out, lo = [], 1
    while lo <= largest:
        out.append(4 * lo // 3)
        lo = out[-1] + 1
    out.append(4 * lo // 3)
    return np.array(out, dtype=np.int64)


def signatures(features: np.ndarray, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the number of the set that each belongs to. ``common`` is sorted."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    highs = bands(int(size.max()) if len(size) else 1)
    band = np.searchsorted(highs, size)
    sigs, whose = [], []
    tiny = (size > 2) & (size < TINY)  # below three features, only equal sets link
    rank = np.arange(len(owner)) - at[:-1][owner]
    pick = tiny[owner] & (rank <= size[owner] // 4)
    sigs.append(mix(features[pick] ^ SALT_TINY))
    whose.append(owner[pick])
    # partners of sets at the border of TINY have up to a third more features
    pick = (size[owner] >= TINY) & (size[owner] <= 4 * (TINY - 1) // 3) & (rank <= size[owner] // 4)
    sigs.append(mix(features[pick] ^ SALT_TINY))
    whose.append(owner[pick])
    big = size >= TINY
    rare = big[owner]
    if len(common):
        k = np.minimum(np.searchsorted(common, features), len(common) - 1)
        rare &= common[k] != features

    def sign(mask: np.ndarray, step: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signature and owner of each touched partition, and the number of touched partitions of each set."""
        f, o = features[mask], owner[mask]
        b = band[o] + step
        parts = highs[b] * 31 // 100 + 2
        part = (mix(f + salt) >> U64(33)).astype(np.int64) % parts
        order = np.argsort(o * (int(parts.max()) + 1 if len(parts) else 1) + part)
        f, o, part, b = f[order], o[order], part[order], b[order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        sums = _sums(mix(f ^ salt), np.append(first, len(f)))
        sig = mix(sums ^ mix((part[first].astype(U64) << U64(16)) + b[first].astype(U64) + salt))
        return sig, o[first], np.bincount(o[first], minlength=len(size))

    for step in (0, 1):
        sig, o, touched = sign(rare, step, U64(0))
        sigs.append(sig)
        whose.append(o)
        # partners within this band and the one below differ in at most so many features
        apart = (size + np.minimum(highs[np.minimum(band + step, len(highs) - 1)], 4 * size // 3)) // 7
        weak = big & (touched <= apart)
        if not weak.any():
            continue
        sig, o, touched = sign(weak[owner], step, SALT_FULL)
        sigs.append(sig)
        whose.append(o)
        for s in np.flatnonzero(weak & (touched <= apart)):
            b = int(band[s]) + step
            parts = int(highs[b]) * 31 // 100 + 2
            mine = features[at[s] : at[s + 1]]
            empty = np.setdiff1d(np.arange(parts), (mix(mine + SALT_FULL) >> U64(33)).astype(np.int64) % parts)
            sigs.append(mix((empty.astype(U64) << U64(16)) + U64(b) + SALT_EMPTY))
            whose.append(np.full(len(empty), s))
    return np.concatenate(sigs), np.concatenate(whose)


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        for first, last in blocks(at):
            features, where = feature_sets(data, at[first : last + 1])
            yield batch.column(0).slice(first, last - first), features, where


def _distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, features, offsets) of the distinct sets of runs of blocks, FLUSH features at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        names = np.concatenate([h[0] for h in held])
        features = np.concatenate([h[1] for h in held])
        sizes = np.concatenate([h[2] for h in held])
        at = np.concatenate([[0], np.cumsum(sizes)])
        names, first = np.unique(names, return_index=True)
        n = sizes[first]
        stop = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(stop[-1]) + np.repeat(at[first] - stop[:-1], n)
        return names, features[place], stop

    for _, features, at in _each_block(batches):
        full = np.diff(at) > 0
        held.append((set_ids(features, at)[full], features, np.diff(at)[full]))
        size += len(features)
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def sketches(features: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: two to four bits for each of its features, a power of two."""
    size = np.diff(at)
    bits = 64 << np.ceil(np.log2(np.maximum(size, 32) / 32)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    place = begin[owner] + (features & (bits[owner] - 1).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin, begin[1:])]


def least_apart(x: bytes, y: bytes) -> int:
    """Features in which two sets differ at least, by their sketches."""
    a, b = sorted((np.frombuffer(x, U64), np.frombuffer(y, U64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sets_of(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, n_shingles, vertex (name of the set, null if it is empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, features, at in _each_block(batches):
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(set_ids(features, at).view(np.int64), mask=n == 0), pa.array(sketches(features, at), pa.binary())], names=["doc_id", "n_shingles", "vertex", "sketch"])

    return _texts(docs).mapInArrow(released(run), "doc_id long, n_shingles long, vertex long, sketch binary")


def common_features(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Features of more than one distinct set in COMMON (never many: so many times the mean set size at most), and the number of features.

    Such a feature passes the share in at least one run of sets; counts of the runs where it does are summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, features, at in _distinct_sets(batches):
            ordered = np.sort(features)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(ordered)))
            often = count > max(len(names) / COMMON, 8)
            f = np.append(ordered[first[often]].view(np.int64), 0)
            kind = np.append(np.zeros(often.sum(), np.int8), 1).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(f), pa.array(np.append(count[often], len(names))), pa.array(np.append(np.zeros(often.sum(), np.int64), len(features)))], names=["kind", "f", "n", "features"])

    found = cut_lineage(_texts(docs).mapInArrow(released(run), "kind byte, f long, n long, features long").groupBy("kind", "f").agg(F.sum("n").alias("n"), F.sum("features").alias("features")))
    total = found.where("kind = 1").first()
    if total is None:
        return np.zeros(0, U64), 0
    rows = found.where((F.col("kind") == 0) & (F.col("n") > total.n / COMMON)).select("f").toPandas()
    return np.sort(rows["f"].to_numpy(dtype=np.int64).view(U64)), int(total.features)


def signature_groups(docs: DataFrame) -> DataFrame:
    """Candidates: pairs (kind 0: a, b) of group members with their group's centre, and the groups of three
    and more (kind 1: a is the group's name, ``members`` has its vertices), each once a bucket at most."""
    common, total = common_features(docs)
    buckets = max(48, -(-total // FEATURES_A_BUCKET))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, features, at in _distinct_sets(batches):
            parts = []
            for first, last in blocks(at, SLICE):
                s, w = signatures(features[at[first] : at[last]], at[first : last + 1] - at[first], common)
                parts.append((s, w + first))
            sig, whose = (np.concatenate([p[k] for p in parts]) for k in (0, 1)) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))
            bucket = (sig >> U64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            sig, whose = sig[order], whose[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                s, w = sig[cut[b] : cut[b + 1]], whose[cut[b] : cut[b + 1]]
                used, local = np.unique(w, return_inverse=True)
                kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays([
                    pa.array([b], pa.int32()), pa.array([s.astype(np.uint32).tobytes()], pa.binary()), pa.array([(s >> U64(32)).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([local.astype(kind).tobytes()], pa.binary()), pa.array([names[used].tobytes()], pa.binary()),
                ], names=["bucket", "low", "high", "local", "names"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, *raw in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in ("low", "high", "local", "names"))):
                if bucket != now and held:
                    yield _grouped(held)
                    held = []
                now = bucket
                # views of the batch: neither its bytes nor the vertices of its signatures are copied out
                low, high, local, names = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(raw, (np.uint32, np.uint8, np.uint8, U64)))
                held.append((low, high, local.view(np.uint16 if len(names) < 1 << 16 else np.uint32), names))
        if held:
            yield _grouped(held)

    packed = _texts(docs).mapInArrow(released(sign), "bucket int, low binary, high binary, local binary, names binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(released(groups), "kind byte, a long, b long, members binary")


def _signed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | (high.astype(U64) << U64(32))


def _grouped(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs and groups of one bucket from pieces (low, high: signatures; local: places in names)."""
    every = np.concatenate([_signed(low, high) for low, high, _, _ in held])
    every.sort()
    again = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    # few signatures occur twice: only theirs are looked up
    sigs, vertices = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for low, high, local, names in held if len(again) else ():
        sig = _signed(low, high)
        hit = again[np.minimum(np.searchsorted(again, sig), len(again) - 1)] == sig
        sigs.append(sig[hit])
        vertices.append(names[local[hit]])
    sig, vertex = np.concatenate(sigs), np.concatenate(vertices)
    order = np.lexsort((vertex, sig))
    sig, vertex = sig[order], vertex[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (vertex[1:] != vertex[:-1])
    sig, vertex = sig[new], vertex[new]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    ends = np.append(first, len(sig))
    gid = mix(_sums(mix(vertex), ends) + U64(1)) if len(first) else np.zeros(0, U64)
    _, once = np.unique(gid, return_index=True)
    once = once[np.diff(ends)[once] > 1]
    n = np.diff(ends)[once]
    stop = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(stop[-1]) + np.repeat(ends[once] - stop[:-1], n)
    member, gid = vertex[place], np.repeat(gid[once], n)
    # the centre is the member that comes first in one of a few pseudo-random orders
    if len(member):
        turn = np.where(np.repeat(n, n) >= CROWD, gid % U64(CENTRES), U64(0))
        key = mix(member + turn * U64(0x632BE59BD9B4E019))
        best = np.repeat(np.minimum.reduceat(key, stop[:-1]), n)
        centre = np.repeat(member[key == best], n)
    else:
        centre = member
    apart = member != centre
    ends_of = np.stack([member[apart], centre[apart]])
    low, high = ends_of.view(np.int64).min(axis=0), ends_of.view(np.int64).max(axis=0)
    pairs = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
    wide = np.flatnonzero(n > 2)
    names = gid[stop[:-1]][wide].view(np.int64) if len(n) else np.zeros(0, np.int64)
    lists = [member[stop[k] : stop[k + 1]].tobytes() for k in wide]
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.array([0, 1], np.int8), [len(pairs), len(wide)])), pa.array(np.concatenate([pairs[:, 0], names])),
        pa.array(np.concatenate([pairs[:, 1], names])), pa.array([None] * len(pairs) + lists, pa.binary())], names=["kind", "a", "b", "members"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 256):
            gid, lists = batch.column(0).slice(first, 256), batch.column(1).slice(first, 256)
            lists = [np.frombuffer(x.as_buffer(), np.int64) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(gid), [len(x) for x in lists])), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))], names=["gid", "vertex"])


def _pack(features: np.ndarray) -> bytes:
    return np.ascontiguousarray(features).view(np.uint8).reshape(-1, 8)[:, :FEATURE_BYTES].tobytes()


def _unpack(raw: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(raw) // FEATURE_BYTES, 8), np.uint8)
    out[:, :FEATURE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, FEATURE_BYTES)
    return out.view(U64).ravel()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
        good = [7 * least_apart(x.as_py(), y.as_py()) <= k for x, y, k in zip(batch.column(4), batch.column(5), n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = _unpack(x.as_buffer()), _unpack(y.as_buffer())
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            good.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, features, at in _distinct_sets(batches):
        for first in range(0, len(names), 512):
            last = min(first + 512, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[first:last].view(np.int64)), pa.array([_pack(features[a:b]) for a, b in zip(at[first:last], at[first + 1 : last + 1])], pa.binary())], names=["vertex", "features"])


def _across(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each piece of a group (rows sorted by gid, lo, hi, blk) that sizes and sketches
    allow, packed by bucket: two documents share many groups, so a task sends each pair once."""
    held: list[dict] = []
    pairs: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate(pairs), axis=0)
        bucket = (mix(found[:, 0].copy().view(U64) ^ mix(found[:, 1].copy().view(U64))) >> U64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([found[order[cut[b] : cut[b + 1]]].tobytes()], pa.binary())], names=["bucket", "pairs"])

    def piece() -> np.ndarray:
        vertex, part, n, blk = (np.array([r[c] for r in held], dtype=np.int64) for c in ("vertex", "part", "n_shingles", "blk"))
        width = np.array([len(r["sketch"]) for r in held])
        found = []
        for w in np.unique(width):
            wide = np.flatnonzero(width >= w)
            narrow = np.flatnonzero(width == w)
            cards = []
            for k in wide:
                card = np.frombuffer(held[k]["sketch"], U64)
                while len(card) * 8 > w:
                    card = card[: len(card) // 2] ^ card[len(card) // 2 :]
                cards.append(card)
            cards = np.stack(cards)
            own = cards[np.searchsorted(wide, narrow)]
            for first in range(0, len(narrow), 16):
                a = narrow[first : first + 16]
                apart = np.bitwise_count(own[first : first + 16, None, :] ^ cards[None]).sum(axis=2)
                na, nb = n[a][:, None], n[wide][None]
                good = (7 * apart <= na + nb) & (4 * na >= 3 * nb) & (4 * nb >= 3 * na) & (part[a][:, None] != part[wide][None])
                # among equal widths each pair once; between blocks only pairs of both
                good &= (width[wide][None] > w) | (a[:, None] < wide[None])
                if held[0]["lo"] != held[0]["hi"]:
                    good &= blk[a][:, None] != blk[wide][None]
                i, j = np.nonzero(good)
                found.append(np.stack([vertex[a[i]], vertex[wide[j]]]))
        return np.sort(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=0).T

    for batch in batches:
        for r in batch.to_pylist():
            if held and any(held[0][c] != r[c] for c in ("gid", "lo", "hi")):
                pairs.append(piece())
                held = []
                if sum(map(len, pairs)) > FLUSH:
                    yield from flush()
                    pairs.clear()
            held.append(r)
    if held:
        pairs.append(piece())
    if pairs:
        yield from flush()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each bucket (rows sorted by bucket)."""
    held, now = [], None

    def distinct() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and bucket != now:
                yield distinct()
                held = []
            now = bucket
            held.append(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 2))
    if held:
        yield distinct()


def _sized_pairs(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that sizes and sketches allow to link."""
    sized = _both(pairs, cards, "n_shingles", "sketch").where("4 * n_shingles_a >= 3 * n_shingles_b and 4 * n_shingles_b >= 3 * n_shingles_a")
    return sized.mapInArrow(_near, "a long, b long")


def _both(pairs: DataFrame, of: DataFrame, *cols: str) -> DataFrame:
    for end in "ab":
        pairs = pairs.join(of.select(F.col("vertex").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols]), end)
    return pairs.select("a", "b", *[f"{c}_{end}" for c in cols for end in "ab"])


def _checked(near: DataFrame, cards: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of near(a, b) (materialised) whose sets link. cards: vertex, n_shingles, sketch, sender (a document that has the set)."""
    # one document of each set sends it; the others stop before the shuffle
    wanted = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "vertex")
    senders = small_side(cut_lineage(cards.join(wanted, "vertex", "left_semi").select("sender").distinct()))
    texts = _texts(docs)
    chosen = texts.join(senders, texts["doc_id"].eqNullSafe(senders["sender"]), "left_semi")
    sets = chosen.mapInArrow(released(_named_sets), "vertex long, features binary")
    return cut_lineage(_both(near, sets, "features").mapInArrow(_linked, "a long, b long").distinct())


def similar_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: components of documents with 5-word Jaccard similarity of 3/4 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer
    than five words is one shingle. Null text or text without words: no shingles, linked
    with nothing, its own component. Null doc_id: the text still links others, but cannot
    be a component's name; alone it has a null component. Rows that repeat an id are each
    returned; ties cannot occur. Empty table: no rows. Other columns are dropped.
    """
    texts_in = docs.rdd.getNumPartitions()
    base = cut_lineage(sets_of(docs))
    found = stored(signature_groups(docs))
    pairs = cut_lineage(found.where("kind = 0").select("a", "b").distinct())
    wanted = small_side(cut_lineage(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "vertex")))
    cards = cut_lineage(base.join(wanted, "vertex", "left_semi").groupBy("vertex").agg(F.min("doc_id").alias("sender"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")))
    links = _checked(cut_lineage(_sized_pairs(pairs, cards)), cards, docs)
    parts = components(links)
    groups = found.where("kind = 1").select("a", "members").mapInArrow(_members, "gid long, vertex long")
    member = groups.join(small_side(parts.withColumnRenamed("node", "vertex")), "vertex", "left").select("gid", "vertex", F.coalesce("component", "vertex").alias("part"))
    split = member.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("gid")
    open_groups = cut_lineage(member.join(split, "gid", "left_semi"))
    pieces = open_groups.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"))
    dealt = (
        open_groups.join(pieces, "gid").join(cards.select("vertex", "n_shingles", "sketch"), "vertex")
        .withColumn("blk", F.pmod(F.xxhash64("vertex"), F.col("g")).cast("int"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("gid", F.least("blk", "mate").alias("lo"), F.greatest("blk", "mate").alias("hi"), "blk", "vertex", "part", "n_shingles", "sketch")
        .repartition("gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi", "blk")
    )
    buckets = max(48, texts_in)
    packed = dealt.mapInArrow(lambda batches: _across(batches, buckets), "bucket int, pairs binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    more = cut_lineage(packed.mapInArrow(_unpacked, "a long, b long").join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        parts = components(links.union(_checked(more, cards, docs)))
    smallest = base.where("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("first"))
    named_parts = smallest.join(parts.withColumnRenamed("node", "vertex"), "vertex", "left").select("vertex", "first", F.coalesce("component", "vertex").alias("part"))
    named_parts = cut_lineage(named_parts)
    answer = cut_lineage(named_parts.join(named_parts.groupBy("part").agg(F.min("first").alias("component_id")), "part").select("vertex", "component_id"))
    return base.join(answer, "vertex", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

