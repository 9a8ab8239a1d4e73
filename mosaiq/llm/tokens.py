"""Token counts at every prefix of a text, by dynamic programming over the last token of each prefix.

A piece sequence is what the tokenizer gives exactly if each neighbouring pair is: so the
encoding of a prefix is the encoding of a shorter prefix plus one last piece that is
compatible with the piece before it. No merge of the tokenizer crosses from another
character to the mark that stands for a space, so words are counted on their own and a
text's counts are the words' counts put one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from mosaiq.llm.common import text_buffers

MARK = "▁"
CACHE_WORDS = 1_000_000
"""Words whose counts a worker remembers; then it starts anew."""

_SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PrefixCounter:
    """Prefix counts of one merge-based piece model with byte fallback and a leading space mark."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        # 2: a piece, 1: only the end of a piece
        self.ends: dict[str, int] = {p[k:]: 1 for p in self.score for k in range(1, len(p))}
        self.ends.update({p: 2 for p in self.score})
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self, MARK)
        self.bare = _Words(self, "")

    def merge(self, text: str) -> list[str]:
        """The tokenizer's own merges: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay as they are side by side (an empty ``left``: ``right`` alone)."""
        if len(self.pairs) >= CACHE_WORDS:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def steps(self, text: str) -> bytes:
        """Change of the token count from each prefix to the next, one signed byte a character."""
        count, last = [0], [""]
        ends, known, fits, score = self.ends.get, self.pairs.get, self.fits, self.score
        for i in range(1, len(text) + 1):
            size, kind = 1, 2
            piece = text[i - 1]
            while True:
                if kind == 2 or size == 1:
                    before = last[i - size]
                    fit = known((before, piece))
                    if fit or fit is None and fits(before, piece):
                        # a character that is no piece falls back to its bytes
                        count.append(count[i - size] + (1 if size > 1 or piece in score else len(piece.encode())))
                        last.append(piece)
                        break
                size += 1
                piece = text[i - size : i]
                kind = ends(piece)
                if size > i or kind is None:
                    raise ValueError(f"no last piece for a prefix of {text[:80]!r}")
        return np.diff(count).astype(np.int8).tobytes()

    def text_steps(self, text: str) -> bytes:
        """As ``steps`` for a whole text: the first character also carries the leading mark."""
        if not text:
            return b""
        if MARK in text or text[0] == " " or "  " in text:
            joined = b"".join(map(self.bare.__getitem__, _SEGMENTS.findall(MARK + text.replace(" ", MARK))))
        else:
            joined = b"".join(map(self.words.__getitem__, text.split(" ")))
        first = np.frombuffer(joined[:2], dtype=np.int8).sum(dtype=np.int8)
        return first.tobytes() + joined[2:]


class _Words(dict):
    """Steps of words, made when first asked for; lines inside a word are counted apart."""

    def __init__(self, counter: PrefixCounter, lead: str):
        super().__init__()
        self.counter, self.lead = counter, lead

    def __missing__(self, word: str) -> bytes:
        if "\n" in word and "\n" not in self.counter.score:
            head, *rest = word.split("\n")
            bare = self.counter.bare
            return (self[head] if head or self.lead else b"") + b"".join(b"\x01" + bare[x] for x in rest)
        if len(self) >= CACHE_WORDS:
            self.clear()
        steps = self.counter.steps(self.lead + word)
        if len(word) <= 64:
            self[word] = steps
        return steps


_COUNTERS: dict[str, PrefixCounter] = {}


def _counter(model_file: str) -> PrefixCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def prefix_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, steps.

    ``steps`` has one signed byte for each character: the change of the exact token
    count when the prefix grows by it, so running sums are the counts of all prefixes.
    Null text counts as empty (no tokens, empty steps). Rows pass one by one: repeated
    rows, null ids and empty tables need no rule. Other columns are dropped. Each worker
    reads ``model_file``, which every node has.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("steps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            column = batch.column(1)
            _, at = text_buffers(column)
            for first in range(0, len(column), 256):
                texts = column.slice(first, 256)
                steps = [counter.text_steps(t or "") for t in texts.to_pylist()]
                totals = [int(np.frombuffer(s, dtype=np.int8).sum(dtype=np.int64)) for s in steps]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, 256), pa.array(np.diff(at[first : first + len(texts) + 1])), pa.array(totals, pa.int64()), pa.array(steps, pa.binary())],
                    names=schema.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@F.pandas_udf(T.LongType())
def count_at(steps: pd.Series, length: pd.Series) -> pd.Series:
    """Tokens of the prefix of ``length`` characters (a longer one: of the whole text)."""
    return pd.Series([None if s is None or n is None else int(np.frombuffer(s, dtype=np.int8)[: max(int(n), 0)].sum(dtype=np.int64)) for s, n in zip(steps, length)], dtype="Int64")


@F.pandas_udf(T.LongType())
def longest_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    out = []
    for s, n in zip(steps, budget):
        if s is None or n is None:
            out.append(None)
            continue
        within = np.flatnonzero(np.concatenate([[0], np.cumsum(np.frombuffer(s, dtype=np.int8), dtype=np.int64)]) <= n)
        out.append(int(within[-1]) if len(within) else 0)
    return pd.Series(out, dtype="Int64")
