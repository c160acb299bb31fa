"""Evaluation texts leaking into training text: an FM-index per shard, searched backward for the phrases of the test items.

Every leak (20 consecutive words of an item, at most one in eight changed, added or missing) holds at least six
consecutive words of the item unchanged: n words with e <= n/8 edits leave e + 1 runs, the longest of them of at least
(n - e) / (e + 1) > 5 words for some passage of 20 to 39 words in it. So the phrases searched are all six-word windows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE, ONE_IN, PHRASE = 20, 8, 6
#: Symbols per index, and items searched at once: both bound memory, neither changes results.
SHARD, SHARD_CHARS, BLOCK_CHARS = 400_000, 64_000_000, 16_000_000
FIELDS = ["doc_id", "item_id", "first_token", "last_token", "first_char", "last_char"]
OTHER = 1

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_UNI = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESC = re.compile(r"\\[nrtfb]")
#: Invisible characters that may stand inside a word.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_ASCII = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str) -> list[bytes]:
    """Letter and digit runs in lower case, without markup, escapes, entities and invisible characters."""
    if "\\" in text:
        text = _ESC.sub(" ", _UNI.sub(lambda m: chr(int(m[1], 16)), text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return [w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())]


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: A sign and what composes with it: combining marks, Hangul vowels and finals, voiced marks.
_CLUSTER = re.compile(r"(?s).[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093c\u1160-\u11ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f\uff9e\uff9f]*")


def places(text: str) -> list[tuple[int, int]]:
    """(first, last) character, last exclusive, of each of ``tokens(text)`` in the text as it stands.

    The same steps as in tokens(), each carrying for every sign where it came from; for the few texts that hold a passage.
    """
    origin = [(i, i + 1) for i in range(len(text))]

    def sub(pattern: re.Pattern, by) -> None:
        nonlocal text, origin
        out, at, pos = [], [], 0
        for m in pattern.finditer(text):
            new = by(m)
            out += [text[pos : m.start()], new]
            at += origin[pos : m.start()]
            at += [(origin[m.start()][0], origin[m.end() - 1][1])] * len(new)
            pos = m.end()
        out.append(text[pos:])
        text, origin = "".join(out), at + origin[pos:]

    if "\\" in text:
        sub(_UNI, lambda m: chr(int(m[1], 16)))
        sub(_ESC, lambda m: " ")
    if "&" in text:
        sub(_ENTITY, lambda m: html.unescape(m[0]))
    if "<" in text:
        sub(_TAG, lambda m: "")
    if not text.isascii():
        sub(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m[0]))
        sub(_INVISIBLE, lambda m: "")
        sub(re.compile("(?s)."), lambda m: m[0].lower())
    return [(origin[m.start()][0], origin[m.end() - 1][1]) for m in _WORD.finditer(text)]


class FMIndex:
    """A wavelet matrix over the BWT of an integer sequence, with every ``sample``-th suffix position kept."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        s = np.append(seq.astype(np.int64), 0)  # 0 ends the text and sorts first
        n = len(s)
        self.n, self.bits = n, max(1, int(s.max()).bit_length())
        sa, rank, k = np.argsort(s, kind="stable"), s, 1
        while True:
            sorted_rank = rank[sa]
            step = np.empty(n, dtype=np.int64)
            step[0] = 0
            if k == 1:
                step[1:] = sorted_rank[1:] != sorted_rank[:-1]
            else:
                second = np.where(sa + k // 2 < n, rank[np.minimum(sa + k // 2, n - 1)], -1)
                step[1:] = (sorted_rank[1:] != sorted_rank[:-1]) | (second[1:] != second[:-1])
            dense = np.empty(n, dtype=np.int64)
            dense[sa] = np.cumsum(step)
            rank = dense
            if rank[sa[-1]] == n - 1:
                break
            nxt = np.full(n, -1, dtype=np.int64)
            nxt[: n - k] = rank[k:]
            sa = np.argsort(rank * (n + 1) + nxt + 1)
            k *= 2
        self.bwt = s[sa - 1]
        counts = np.bincount(s, minlength=(1 << self.bits) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels, self.zeros = [], []
        x = self.bwt
        for b in range(self.bits - 1, -1, -1):
            one = (x >> b) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(one))).astype(np.int32))
            self.zeros.append(n - int(one.sum()))
            x = np.concatenate((x[one == 0], x[one == 1]))
        self.base = self._walk(np.arange(1 << self.bits), np.zeros(1 << self.bits, dtype=np.int64))
        mark = sa % sample == 0
        self.marked, self.mark_rank, self.at = mark, np.cumsum(mark) - 1, sa[mark]

    def _walk(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for j, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[j][pos]
            pos = np.where((c >> b) & 1, self.zeros[j] + ones, pos - ones)
        return pos

    def rank(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often symbol c stands before pos in the BWT."""
        return self._walk(c, pos) - self.base[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of many phrases at once; phrases are rows, right-aligned, read from the back."""
        live = np.flatnonzero(phrases.max(axis=1) < (1 << self.bits))
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        hi[live] = self.n
        width = phrases.shape[1]
        for t in range(1, width + 1):
            live = live[(hi[live] > lo[live])]
            now = live[lengths[live] >= t]
            if not len(now):
                break
            c = phrases[now, width - t]
            lo[now] = self.first[c] + self.rank(c, lo[now])
            hi[now] = self.first[c] + self.rank(c, hi[now])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the next sampled one."""
        row, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.marked[row])
        while len(todo):
            c = self.bwt[row[todo]]
            row[todo] = self.first[c] + self.rank(c, row[todo])
            steps[todo] += 1
            todo = todo[~self.marked[row[todo]]]
        return self.at[self.mark_rank[row]] + steps


class Items:
    """The test items as word sequences, their vocabulary, and the phrases to search."""

    def __init__(self, rows: list[tuple[int, str]], shared: set[str]):
        self.ids, self.vocab = [], {}
        self.tok, self.word, self.count = [], [], []  # per item: symbols, word number of each, whether a word counts
        phrases, where = [], []
        for item_id, text in rows:
            sym, word, counts, w = [], [], [], 0
            for sentence in _SENTENCE.split(text or ""):
                own = " ".join(t.decode() for t in tokens(sentence)) not in shared
                for raw in sentence.split():
                    parts = tokens(raw)
                    if parts:
                        sym += [self.vocab.setdefault(p, len(self.vocab) + 2) for p in parts]
                        word += [w] * len(parts)
                        counts.append(own)
                        w += 1
            if sum(counts) < PASSAGE:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.tok.append(np.array(sym))
            self.word.append(np.array(word))
            self.count.append(np.array(counts))
            start = np.searchsorted(self.word[k], np.arange(w + 1))
            for a in range(w - PHRASE + 1):
                if all(counts[a : a + PHRASE]):
                    phrases.append(sym[start[a] : start[a + PHRASE]])
                    where.append((k, start[a]))
        width = max(map(len, phrases), default=1)
        self.phrases = np.zeros((len(phrases), width), dtype=np.int64)
        self.lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        for i, p in enumerate(phrases):
            self.phrases[i, width - len(p) :] = p
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)
        self.least = int(self.lengths.min()) if len(phrases) else 1

    def symbols(self, text: str) -> np.ndarray:
        words, get = tokens(text), self.vocab.get
        return np.fromiter((get(w, OTHER) for w in words), dtype=np.int64, count=len(words))

    def align(self, item: int, at: int, doc: np.ndarray, pos: int) -> np.ndarray:
        """Doc position of each item symbol, -1 where none, walking both ways from a seed and over gaps of up to six."""
        tok = self.tok[item]
        got = np.full(len(tok), -1, dtype=np.int64)
        for d in (1, -1):
            i, j = (at, pos) if d == 1 else (at - 1, pos - 1)
            while 0 <= i < len(tok) and 0 <= j < len(doc):
                if tok[i] == doc[j]:
                    got[i] = j
                    i, j = i + d, j + d
                    continue
                for a, b in _GAPS:
                    x, y = i + a * d, j + b * d
                    if 0 <= x < len(tok) and 0 <= y < len(doc) and tok[x] == doc[y]:
                        x2, y2 = x + d, y + d
                        if not (0 <= x2 < len(tok) and 0 <= y2 < len(doc)) or tok[x2] == doc[y2]:
                            i, j = x, y
                            break
                else:
                    break
        return got

    def passage(self, item: int, got: np.ndarray) -> tuple[int, int] | None:
        """First and last doc position of the longest passage that is a leak, or None."""
        word, counts = self.word[item], self.count[item]
        n = len(counts)
        size, hit = np.bincount(word, minlength=n), np.bincount(word[got >= 0], minlength=n)
        whole = hit == size
        ends = np.flatnonzero(whole)
        if len(ends) < 2:
            return None
        cost = (~whole & counts).astype(np.int64)
        first = np.searchsorted(word, np.arange(n))
        last = first + size - 1
        # words added in the text between two whole words, beyond those that stand for changed ones
        for a, b in zip(ends, ends[1:]):
            extra = int(got[first[b]] - got[last[a]] - 1) - int(cost[a + 1 : b].sum())
            missing = int((got[first[a + 1] : first[b]] >= 0).sum())
            if extra - missing > 0 and (b == a + 1 or counts[a + 1 : b].any()):
                cost[b] += extra - missing
        total, weight = np.concatenate(([0], np.cumsum(cost))), np.concatenate(([0], np.cumsum(counts)))
        length = weight[ends + 1][None, :] - weight[ends][:, None]
        edits = total[ends + 1][None, :] - total[ends + 0][:, None] - cost[ends][:, None]
        good = (length >= PASSAGE) & (edits * ONE_IN <= length)
        if not good.any():
            return None
        i, j = np.unravel_index(np.where(good, length, -1).argmax(), good.shape)
        return int(got[first[ends[i]]]), int(got[last[ends[j]]])


_GAPS = sorted(((a, b) for a in range(7) for b in range(7) if a or b), key=lambda g: (max(g), sum(g)))


def _search(items: Items, ids: list, docs: list[np.ndarray], texts: list[str] | None) -> list[tuple]:
    """(doc_id, item_id, first, last, first_char, last_char) for the documents of one shard; no characters without ``texts``."""
    # Words of no item become separators; runs too short for any phrase become one, so the index holds what can match.
    parts, origin, owner = [], [], []
    for k, d in enumerate(docs):
        inside = d > OTHER
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= items.least:
                parts += [d[a:b], _SEPARATOR]
                origin.append(a)
                owner.append(k)
    if not parts:
        return []
    starts = np.cumsum([0] + [len(p) for p in parts])[:-1:2]
    index = FMIndex(np.concatenate(parts))
    lo, hi = index.search(items.phrases, items.lengths)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return []
    width = hi[some] - lo[some]
    phrase = np.repeat(some, width)
    rows = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[some], width)
    at = index.locate(rows)
    run = np.searchsorted(starts, at, side="right") - 1
    doc, pos = np.array(owner)[run], np.array(origin)[run] + at - starts[run]
    item, offset = items.where[phrase, 0], items.where[phrase, 1]
    out = []
    order = np.lexsort((pos, item, doc))
    seen: tuple | None = None
    placed: tuple[int, list] = (-1, [])
    for r in order:
        key = (doc[r], item[r])
        if key != (seen and seen[0]):
            seen = (key, set())
        # a seed that an earlier alignment of this pair already went through adds nothing
        if (offset[r], pos[r]) in seen[1]:
            continue
        got = items.align(item[r], offset[r], docs[doc[r]], pos[r])
        on = np.flatnonzero(got >= 0)
        seen[1].update(zip(on.tolist(), got[on].tolist()))
        if span := items.passage(item[r], got):
            chars = (None, None)
            if texts is not None:
                if placed[0] != doc[r]:
                    placed = int(doc[r]), places(texts[doc[r]])
                chars = placed[1][span[0]][0], placed[1][span[1]][1]
            out.append((ids[doc[r]], items.ids[item[r]], *span, *chars))
    return out


_SEPARATOR = np.array([OTHER])


def leaks(documents: DataFrame, eval_items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", chars: bool = True) -> DataFrame:
    """(doc_id, item_id, first_token, last_token, first_char, last_char): every passage of an item found in a document.

    Tokens are those of ``tokens``, last included; characters are those of the text as stored, from 0, last excluded; null unless
    ``chars``, as they cost a second, slower reading of the texts that hold a passage.

    Null and empty texts hold nothing. Items of fewer than 20 words of their own cannot leak. Sentences found in several
    items don't count, nor do they interrupt a passage. Identical items each match. Equal documents each give rows.
    The items are a stated query set, searched in blocks of bounded size; documents are never shuffled or collected.
    """
    spark = documents.sparkSession
    rows = eval_items.select("item_id", "text").where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_CHARS) + 1
    shared = _shared_sentences(rows)
    parts = []
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        items = spark.sparkContext.broadcast(Items([tuple(r) for r in block.orderBy("item_id", "text").collect()], shared))
        parts.append(_block(documents.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")), items, chars))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shared_sentences(rows: DataFrame) -> set[str]:
    """Sentences, as normalised words, that stand in more than one distinct item; as many as the items can hold."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(i, s) for s in {" ".join(w.decode() for w in tokens(x)) for x in _SENTENCE.split(t)} if s]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["item_id", "s"])

    got = rows.mapInArrow(split, "item_id bigint, s string").groupBy("s").agg(F.countDistinct("item_id").alias("n")).where("n > 1")
    return {r["s"] for r in got.collect()}


def _block(documents: DataFrame, items, with_chars: bool) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Items = items.value
        ids, docs, texts, size, chars = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            found = _search(q, ids, docs, texts if with_chars else None) if len(q.lengths) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(6)], FIELDS)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if not t or i is None:
                    continue
                d = q.symbols(t)
                known = int((d > OTHER).sum())
                if known < PHRASE:
                    continue
                ids.append(i)
                docs.append(d.astype(np.int32))
                if with_chars:
                    texts.append(t)
                    chars += len(t)
                size += known
                if size >= SHARD or chars >= SHARD_CHARS or len(docs) >= 40_000:
                    yield flush()
                    ids, docs, texts, size, chars = [], [], [], 0, 0
        if docs:
            yield flush()

    return documents.mapInArrow(search, ", ".join(f"{c} bigint" for c in FIELDS))


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """p7_found: (doc_id, item_id)."""
    return leaks(documents, eval_items, chars=False).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, first_char, last_char, items): the characters to cut from each text, last excluded; passages that overlap or have no word between them as one."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("first_token", "last_token", "item_id")
    before = F.max("last_token").over(w.rowsBetween(Window.unboundedPreceding, -1))
    got = leaks(documents, eval_items).withColumn("new", (F.coalesce(before, F.lit(-2)) + 1 < F.col("first_token")).cast("int"))
    return (
        got.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("first_char").alias("first_char"), F.max("last_char").alias("last_char"), F.countDistinct("item_id").alias("items"))
        .drop("span")
    )
