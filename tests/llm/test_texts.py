"""Operators that treat documents one by one, against the tokenizer libraries and plain counts."""

import base64
import collections
import math
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from mosaiq.llm import bpe, language, mixing, scoring, templates, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def strange(frame):
    rnd = random.Random(1)
    texts = ["", None, " ", "  ", "a", " a", "a ", "▁x▁▁y", "a\n\nb\n", "\nfoo  bar\n baz", "日本語", "x" * 700, "ab" * 400, " " * 45,
             "a b\x1c\x1d c\u0085d  e", "it's we'll I'M", "12345 67", "\U0001f937‍♀️", "\x00\x01", "<s></s><unk><0x41>", "=" * 40]
    parts = ["a", "b", "the", "er", " ", "  ", "\n", "é", "日", "▁", "1", "'s", "-", "tion", " of"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    return texts, frame([(k, t) for k, t in enumerate(texts)])


def test_counts_of_every_prefix(strange):
    texts, df = strange
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row in tokens.prefix_counts(df, PIECES).collect():
        text = texts[row.doc_id] or ""
        got = np.cumsum(np.frombuffer(row.steps, np.int8), dtype=int).tolist()
        assert got == [len(model.encode(text[:k])) for k in range(1, len(text) + 1)]
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(model.encode(text)))


def test_budget_questions(frame):
    from pyspark.sql import functions as F

    df = tokens.prefix_counts(frame([(1, "the quick brown fox"), (2, None)]), PIECES)
    got = df.select("doc_id", tokens.count_at("steps", F.lit(3)).alias("at3"), tokens.longest_within("steps", F.lit(2)).alias("within")).orderBy("doc_id").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "the quick brown fox"
    assert got[0].at3 == len(model.encode(text[:3]))
    assert got[0].within == max(k for k in range(len(text) + 1) if len(model.encode(text[:k])) <= 2)
    assert (got[1].at3, got[1].within) == (0, 0)


def test_byte_pairs_as_the_library(strange):
    texts, df = strange
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect():
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_tokens_inside_words():
    ranks = bpe.load_ranks(RANKS)
    made = ["", "a", "the", " the", "xqzxqz", "zzzz", "日本語", "é", " of", "\x00", "abcabcabc", "=" * 40]
    rnd = random.Random(3)
    made += ["".join(rnd.choice("abethr日é1= ") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    raw = [w.encode() for w in made]
    values, offsets, whole = bpe.Tokens(ranks).inside(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]))
    for k, w in enumerate(raw):
        inside = {ranks[w[i:j]] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] in ranks}
        assert whole[k] == ranks.get(w, -1)
        assert values[offsets[k] : offsets[k + 1]].tolist() == ([] if w in ranks else sorted(inside))


def test_encoding_looks_up_no_substring_in_spark(odd):
    plan = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().analyzed().toString()
    assert "crc32" not in plan and len(plan) < 2_500_000


def test_a_byte_without_rank_is_an_error(frame, tmp_path):
    (tmp_path / "few.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate([b"a", b"b", b"ab", b"aba"])))
    coded = lambda text: bpe.encode(frame([(1, text)]), str(tmp_path / "few.tiktoken"), r"\S+").first().ids
    assert coded("abab abaaa ab") == [2, 2, 3, 0, 0, 2]
    with pytest.raises(Exception, match="lacks byte 99"):
        coded("abc")


def test_odd_documents_are_counted_and_encoded(odd):
    assert tokens.prefix_counts(odd, PIECES).count() == 12
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(coded) == 12 and [r.ids for r in coded if r.doc_id == 1] == [[]]
    assert tokens.prefix_counts(odd.limit(0), PIECES).count() == 0 == bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count()


def test_phrases_are_longest_matches():
    sample = b"the cat sat on the mat and the dog "
    tool = language.Automaton(sample)
    rnd = random.Random(2)
    for _ in range(50):
        text = "".join(rnd.choice("thecasondg mz") for _ in range(rnd.randint(1, 60))).encode()
        want, k = 0, 0
        while k < len(text):
            n = 1
            while k + n < len(text) and text[k : k + n + 1] in sample:
                n += 1
            k, want = k + n, want + 1
        assert tool.phrases(np.frombuffer(text, np.uint8).astype(np.int16)[:, None]).tolist() == [want]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.fit(docs)).where(language.held_out())
    right, n = found.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 200 and right / n > 0.97


def test_language_of_odd_documents(odd):
    found = language.identify(odd, language.fit(odd))
    assert "n_lines" in found.columns and [c for c in found.columns if c.lower() == "score"] == ["score"]
    pred = {r.doc_id: r.lang_pred for r in found.collect()}
    assert pred[1] == pred[2] == pred[3] == "und"
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert language.identify(odd.limit(0), {}).count() == 0
    kept = language.identify(odd.selectExpr("*", "7 as _lettered"), language.fit(odd))
    assert {r._lettered for r in kept.collect()} == {7} and kept.columns[-3:] == ["lang_pred", "score", "bits_per_byte"]
    assert {r.lang_pred for r in language.identify(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_mixture_meets_targets(frame):
    rnd = random.Random(3)
    rows = [(k, " ".join(["w"] * rnd.randint(1, 40)), "en", rnd.choice(["a", "a", "a", "b", "c", None, "\U00010000", "￿"])) for k in range(800)]
    got = mixing.mix_sources(frame(rows, copies=9)).collect()
    size = collections.Counter()
    for _, text, _, source in rows:
        size[source] += len(text.split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(size.values())
    while True:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * size[s]}
        if not full:
            target.update({s: share * weight[s] for s in open_})
            break
        target.update({s: 3.0 * size[s] for s in full})
        rest -= sum(3.0 * size[s] for s in full)
        open_ -= full
    taken = collections.Counter()
    source_of = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.source_size == size[source_of[r.doc_id]] and math.isclose(r.target, target[source_of[r.doc_id]])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert sorted(mixing.mix_sources(frame(rows)).collect()) == sorted(got)


def test_mixture_of_odd_documents(odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 12 and {r.taken for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_backoff_scores(frame, odd):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice(["The", "the", "cat", "sat", "on", f"r{rnd.randint(0, 60)}"]) for _ in range(rnd.randint(0, 30)))) for k in range(120)]
    rows += [(500, None), (501, "  \n"), (None, "the cat"), (7, "the cat sat"), (7, "the cat sat")]
    texts = [words(r[1]) for r in rows]
    one = collections.Counter(w for t in texts for w in t)
    two = collections.Counter(p for t in texts for p in zip(t, t[1:]))
    n = sum(one.values())

    def score(t):
        total = 0.0
        for k, w in enumerate(t):
            if k and two[t[k - 1], w] >= 2:
                total += math.log(two[t[k - 1], w] / one[t[k - 1]])
            else:
                total += math.log((0.4 if k else 1) * one[w] / n)
        return total

    want = sorted((-1 if r[0] is None else r[0], len(t), round(score(t), 6)) for r, t in zip(rows, texts))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.log_score, 6)) for r in scoring.backoff_scores(frame(rows)).collect())
    assert got == want
    assert scoring.backoff_scores(odd).count() == 12 and scoring.backoff_scores(odd.limit(0)).count() == 0


def test_ngrams_of_a_chunk_take_few_bytes_a_word():
    rnd = np.random.default_rng(5)
    text = " ".join(f"w{k}" for k in rnd.integers(0, 50_000, 400_000)).encode()
    tracemalloc.start()
    found = scoring._ngrams(np.frombuffer(text, np.uint8), np.array([0, len(text) // 2, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * 400_000  # sorted all at once they took 150 bytes
    assert (np.diff(found["keys"]) > 0).all() and found["n"].sum() == len(found["word"]) + len(found["pair"])


def test_chunks_follow_the_text_and_come_one_a_task(frame, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 100)
    rows = [(k, f"the cat sat on the mat {k % 7}") for k in range(200)]
    seen = []
    monkeypatch.setattr(scoring, "cut_lineage", lambda df, f=scoring.cut_lineage: seen.append(df) or f(df))
    assert len({round(r.log_score, 9) for r in scoring.backoff_scores(frame(rows)).collect()}) <= 7
    chunks = seen[0].rdd.getNumPartitions()
    assert chunks >= sum(len(t) for _, t in rows) // 100
    dealt = seen[0].select("doc_id", F.spark_partition_id().alias("task")).collect()
    of = {}
    for r in dealt:
        chunk = int((int(scoring.mix(np.array([r.doc_id], np.int64).view(np.uint64) ^ scoring._CHUNK_SALT)[0]) >> 40) % chunks)
        of.setdefault(r.task, set()).add(chunk)
    assert all(len(v) == 1 for v in of.values())


def test_recurring_templates_keep_their_first_line(frame):
    rows = [(k, f"{'abcdefgh'[k] * 3} begins here\nVisited {k} times since 20{k}0 by readers\nand {'hgfedcba'[k] * 3} ends") for k in range(8)]
    rows += [(20, "Visited many times since ever by readers"), (21, None), (22, "")]
    got = {r.doc_id: r for r in templates.drop_recurring_lines(frame(rows, n_dropped=77), min_docs=5).collect()}
    assert "Visited 0" in got[0].text and got[0].n_dropped == 0
    assert all("Visited" not in got[k].text and got[k].n_dropped == 1 and got[k].n_lines == 3 for k in range(1, 8))
    assert got[20].text == rows[8][1] and got[21].text is None and (got[21].n_lines, got[22].n_lines) == (0, 1)


def test_a_line_of_two_documents_recurs(frame):
    long_line = " ".join(f"{w}{w[::-1]}" for w in ["alpha", "beta", "gamma", "delta", "omega"] * 11)
    rows = [(1, f"one opening\n{long_line}\none end"), (2, f"another start of it\n{long_line}"), (3, f"twice here only\ntwice here only\n{'x' * 9}")]
    got = {r.doc_id: r for r in templates.drop_recurring_lines(frame(rows)).collect()}
    assert {k: r.n_dropped for k, r in got.items()} == {1: 0, 2: 1, 3: 0}
    assert got[2].text == "another start of it"


def test_similar_lines_become_one_template(frame):
    names = ["anna", "bela", "cora", "dora", "edda", "fara"]
    rows = [(k, f"this page was last changed by {w} on a rainy day") for k, w in enumerate(names)]
    rows += [(50 + k, f"this page was quite {w} and {w} altogether not {w} {w} ever {w}") for k, w in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in templates.drop_recurring_lines(frame(rows), min_docs=5).collect()}
    assert [got[k] for k in range(6)] == [0, 1, 1, 1, 1, 1]
    assert all(got[50 + k] == 0 for k in range(6))


@pytest.mark.parametrize("run", [2, 4096])
def test_crowded_leaves_give_the_same_templates(frame, monkeypatch, run):
    monkeypatch.setattr(templates, "RUN", run)
    names = [f"{a}{b}" for a in ("an", "be", "co", "do") for b in ("na", "la", "ra", "ta")]
    rows = [(k, f"2024-05-{k} 10:{k} 7{k} user {w} logged in from the main office") for k, w in enumerate(names)]
    rows += [(100 + k, " ".join(f"{k}{j}" if j < 3 else f"{w}{'abcdefghijkl'[j]}" for j in range(12))) for k, w in enumerate(names)]
    got = {r.doc_id: r.n_dropped for r in templates.drop_recurring_lines(frame(rows)).collect()}
    assert got == {k: int(0 < k < 16) for k in [*range(16), *range(100, 116)]}


def test_lines_of_odd_documents(odd):
    got = templates.drop_recurring_lines(odd, min_docs=2)
    assert got.count() == 12 and len([c for c in got.columns if c == "n_lines"]) == 1
    assert templates.drop_recurring_lines(odd.limit(0)).count() == 0
