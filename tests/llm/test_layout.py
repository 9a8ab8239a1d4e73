"""Sharding, fill-in-middle over compressed frames and phrase mining, against plain versions."""

import collections
import hashlib
import math
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import frames, phrases, shards


def plain_shard(key, weights):
    def cost(s):
        u = (int(hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        return -math.log(u) / weights[s], s

    return min(cost(s) for s in range(len(weights)))[1]


def test_shards_of_odd_documents(odd):
    rows = shards.assign_shards(odd, slice_rows=2, run_rows=1).collect()
    assert len(rows) == 12 and {r.law for r in rows} == {"key"}
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        {(k, len(t.encode()) + 1, zlib.crc32(t.encode())): n for (k, t), n in texts.items()})
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.shard == plain_shard(r.doc_id, [1.0] * 16) and r.grown_shard == plain_shard(r.doc_id, [1.0] * 17)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.assign_shards(odd.limit(0)).count() == 0


def test_slots_do_not_depend_on_slices_or_tasks(frame):
    df = frame([(k % 40 if k % 3 else None, f"text {k % 50}") for k in range(600)])
    want = sorted(map(str, shards.assign_shards(df, (1.0, 2.0, 3.0), run_rows=3).collect()))
    for slice_rows, parts in ((1, 7), (50, 2), (10_000, 1)):
        assert want == sorted(map(str, shards.assign_shards(df.repartition(parts), (1.0, 2.0, 3.0), slice_rows=slice_rows, run_rows=3).collect()))


def test_weights_and_growth(spark):
    keys = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weights = (1.0, 2.0, 4.0, 1.0)
    rows = shards.assign_shards(keys, weights, new_weight=2.0).groupBy("shard", "grown_shard").count().collect()
    held = collections.Counter()
    for r in rows:
        held[r.shard] += r["count"]
        assert r.grown_shard in (r.shard, 4)
    assert all(abs(held[s] / 30_000 - w / 8) < 0.01 for s, w in enumerate(weights))
    assert abs(sum(r["count"] for r in rows if r.grown_shard == 4) / 30_000 - 0.2) < 0.01
    with pytest.raises(ValueError):
        shards.shard_of(F.col("doc_id"), (1.0, 0.0))


def test_shards_written_and_read(odd, spark, tmp_path):
    shards.write_shards(odd, str(tmp_path / "out"), (1.0, 1.0, 1.0), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 12 and set(back.columns) == {*odd.columns, "shard"}
    assert all(r.shard == plain_shard(r.doc_id, [1.0] * 3) for r in back.collect())
    one = spark.read.parquet(str(tmp_path / "out")).where("shard = 1")
    assert len(one.inputFiles()) <= 6


def plain_fill(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("size", [4, 7, 64, frames.FRAME_BYTES])
def test_fill_in_middle(frame, odd, size):
    rnd = random.Random(size)
    texts = ["".join(rnd.choice("ab é日\U0001f937\n<PSM>") for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, "x <M> y"), (501, "<<P>"), (None, "no id"), (7, texts[7]), (502, None), (503, "")]
    df = frame(rows, n=1, form=2, frames=3)
    made = frames.fill_in_middle(df, frame_bytes=size)
    got = sorted(map(str, (tuple(r) for r in frames.with_texts(made).drop("frames").collect())))
    want = []
    for k, t in rows:
        form, prefix, middle, out = plain_fill(k, t)
        want.append((k, len(t or ""), form, prefix, middle, out))
    assert got == sorted(map(str, want))
    digests = frames.with_digests(made, size).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(str, ((r.doc_id, r.output_sha256, r.restored_sha256) for r in digests))) == sorted(
        map(str, ((k, sha(plain_fill(k, t)[3]), sha(t or "")) for k, t in rows)))
    assert frames.with_digests(frames.fill_in_middle(odd, frame_bytes=max(size, 64)), max(size, 64)).where("restored_sha256 is null").count() == 0
    assert frames.with_digests(frames.fill_in_middle(odd.limit(0))).count() == 0


def test_ranges_open_only_the_frames_they_cut(frame, monkeypatch):
    text = "".join(chr(97 + k % 26) + ("é" if k % 7 == 0 else "") for k in range(20_000))
    stored = frames.store_texts(frame([(1, text)]), 1000).first().frames
    stored = [r.asDict() for r in stored]
    assert sum(f["units"] for f in stored) == len(text) and max(f["units"] for f in stored) <= 1000
    opened = []
    plain = frames.open_frame
    monkeypatch.setattr(frames, "open_frame", lambda f: opened.append(1) or plain(f))
    part = frames.select_range(stored, 1500, 18_500, 1000)
    assert len(opened) <= 2 and "".join(map(plain, part)) == text[1500:18_500]
    for a, b in ((0, 0), (0, len(text)), (999, 1001), (len(text), len(text))):
        assert "".join(map(plain, frames.select_range(stored, a, b, 1000))) == text[a:b]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain_phrases(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for words in plain_pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        inside = any(f[x] >= a for x in f if x[0] == lang and len(x[1]) > len(w) and any(x[1][i : i + len(w)] == w for i in range(len(x[1]) - len(w) + 1)))
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def phrase_texts(seed, rows):
    rnd = random.Random(seed)
    parts = ["the", "The", "a", "big", "é", "日本", "cat", "in", "hat", "a a a", "one two three", ".", ",", "\n", "\t", "  ", "x;y", "!", "\x0b"]
    return [(rnd.choice(["en", "de", None, "und"]), rnd.choice([" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))), None, ""] if k % 9 == 0 else
             [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))])) for k in range(rows)]


@pytest.mark.parametrize("words_a_table, phrases_a_trie", [(1 << 20, 1 << 20), (12, 60)])
def test_phrases(frame, monkeypatch, words_a_table, phrases_a_trie):
    monkeypatch.setattr(phrases, "VOCABULARY", words_a_table)
    monkeypatch.setattr(phrases, "PHRASES", phrases_a_trie)
    rows = phrase_texts(3, 300)
    df = frame([(1, text, lang) for lang, text in rows], word=1, phrase=2, n=3, key=4, w=5)
    got = sorted(tuple(r) for r in phrases.mine_phrases(df, least=8).collect())
    assert got == plain_phrases(rows, 8) and len(got) > 50


def test_phrases_of_odd_documents(odd):
    small = odd.where("length(text) < 1000")
    few = sorted(tuple(r) for r in phrases.mine_phrases(small, least=2, top=3).collect())
    assert few == plain_phrases([(r.lang, r.text) for r in small.collect()], 2, top=3) and few
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.mine_phrases(odd.where("lang <> 'en' or lang is null"), least=2, longest=2).collect()) == [
        x for x in plain_phrases([r for r in rows if r[0] != "en"], 2, longest=2)]
    for df in (odd.limit(0), odd.where("text is null"), odd.where("doc_id = 3")):
        assert phrases.mine_phrases(df).count() == 0


def test_words_across_spans(monkeypatch):
    rnd = random.Random(5)
    texts = [t for _, t in phrase_texts(6, 60)] + ["w" * 300, "x." * 200, "", "."]
    data = "".join(t or "" for t in texts).encode()
    at = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    want = [(k, w, i == 0) for k, t in enumerate(texts) for p in plain_pieces(t) for i, w in enumerate(p)]
    for size in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(phrases, "SPAN_BYTES", size)
        phrases._powers.cache_clear()
        got, hashes = [], {}
        for starts, lengths, value, text, fresh in phrases.split_words(np.frombuffer(data, np.uint8), at):
            for s, n, h, t, f in zip(starts.tolist(), lengths.tolist(), value.tolist(), text.tolist(), fresh.tolist()):
                word = data[s : s + n].decode().translate(LOWER)
                got.append((t, word, f))
                assert hashes.setdefault(word, h) == h
        assert got == want and len(set(hashes.values())) == len(hashes)
    phrases._powers.cache_clear()


def test_trie_against_a_dictionary():
    rnd = random.Random(7)
    for size, longest, limit in ((3, 4, 3), (40, 3, 40), (400, 5, 1 << 40)):
        runs = {tuple(rnd.randint(1, size) for _ in range(longest)) for _ in range(300)}
        runs = {r[:k] for r in runs for k in range(2, longest + 1)}
        table = np.array([list(r) + [0] * (longest - len(r)) for r in runs], np.int32)
        trie = phrases.Trie(table)
        trie.limit = limit
        ids = np.array([rnd.randint(0, size) for _ in range(3000)] + [x for r in runs for x in r], np.int32)
        found = collections.Counter()
        for d, place, state in trie.walk(ids, longest):
            number = trie.accept[state]
            for p, k in zip(place[number >= 0].tolist(), number[number >= 0].tolist()):
                assert trie.phrases[k][:d].tolist() == ids[p : p + d].tolist() and (trie.phrases[k] > 0).sum() == d
                found[p, d] += 1
        want = {(p, d) for d in range(2, longest + 1) for p in range(len(ids) - d + 1) if tuple(ids[p : p + d].tolist()) in runs}
        assert set(found) == want and set(found.values()) == {1}


def test_a_trie_of_many_phrases_is_built_at_once():
    rnd = np.random.default_rng(1)
    pairs = np.unique(np.minimum(rnd.pareto(0.9, (300_000, 2)) * 20 + 1, 30_000).astype(np.int32), axis=0)
    began = time.process_time()
    trie = phrases.Trie(pairs)
    assert time.process_time() - began < 2  # a place looked for by each family took 7 s
    sent = pickle.loads(pickle.dumps(trie))
    assert not hasattr(sent, "phrases")
    for t in (trie, sent):
        (_, place, state), = [x for x in t.walk(pairs.ravel(), 2) if x[0] == 2]
        assert (trie.phrases[t.accept[state]] == np.stack([pairs.ravel()[place], pairs.ravel()[place + 1]], axis=1)).all() and set(range(0, pairs.size, 2)) <= set(place.tolist())
    spread = np.diff(trie.begin)
    assert spread.sum() == (trie.phrases[:, 1] > 0).sum() and spread.max() < 16
