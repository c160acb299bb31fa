"""Generated, packed, vendored and data files among source files: identifier n-gram models per language, and a two-class mixture over them.

No list of phrases, directories or tools is kept. Character trigram and naming-style models of each language are trained on the
identifiers of all heads; they give each file its cross-entropy (mangled names), diversity (template-like names) and oddity
(foreign style). Path pieces (whole and as character 4-grams) and comment words of the head enter as they are, measures in bins.
A two-class naive Bayes mixture over this evidence is fitted by expectation maximisation: it starts from how a file came to be
(added in one piece and never cut down, or reworked again and again) and learns from all files what names, words and styles go with either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import written

#: File extensions and the language whose naming they follow.
LANGUAGES = {
    "java": "java", "kt": "java", "scala": "java", "cs": "csharp", "go": "go", "py": "python", "pyi": "python", "ts": "ecma", "tsx": "ecma", "js": "ecma",
    "jsx": "ecma", "mjs": "ecma", "cjs": "ecma", "vue": "ecma", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "m": "c", "mm": "c", "dart": "dart",
    "rb": "ruby", "php": "php", "rs": "rust", "swift": "swift", "css": "css", "scss": "css", "less": "css", "sql": "sql", "sh": "shell",
}
_LANGS = ["other", *sorted(set(LANGUAGES.values()))]

#: Signs of the n-gram model: 26 letters, digit, _, $, any other, both rims. STYLES naming styles follow a language's trigrams in its row of counts.
SIGNS, STYLES = 32, 8
ROW = SIGNS**3 + STYLES
FIRST, END = 31, 0
#: Buckets of the mixture: the first hold measures and model figures, the rest hashed names and words. Bounds the model, whatever the input.
MEASURES, SLOTS = 1024, 1 << 18
#: Words and grams of one file repeat each other's evidence, so each counts this much; rounds of expectation maximisation.
TEMPER, ROUNDS = 0.3, 4
#: A file added in at most YOUNG revisions of which WHOLE still stands starts as not hand-written, one cut by REWORKED in more than OLD as typed.
YOUNG, WHOLE, OLD, REWORKED = 3, 0.94, 6, 0.15
#: Files of one directory lie together and share most of their slots: plain numbers pack better than a dictionary.
PACKED = {"compression": "zstd", "parquet.enable.dictionary": "false"}
START = {"whole": 0.95, "typed": 0.01, "open": 0.1}

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint64)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_NAME = _LETTER | _DIGIT | (_BYTE == 95) | (_BYTE == 36)
_SPACE = (_BYTE <= 32) | (_BYTE == 127)
_SIGN = np.full(256, 30, dtype=np.int64)
_SIGN[97:123] = _SIGN[65:91] = np.arange(1, 27)
_SIGN[48:58], _SIGN[95], _SIGN[36] = 27, 28, 29
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Edges of the bins of the model figures and measures.
BINS = {
    "entropy": (-1, -0.5, -0.25, 0, 0.25, 0.5, 0.75, 1, 1.5, 2), "diversity": (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99), "oddity": (1, 1.25, 1.5, 1.75, 2, 2.5, 3),
    "length": (2, 3, 4, 5, 6, 8), "odd_path": (-1, -0.5, 0, 0.5, 1, 1.5, 2, 3), "digits": (0.1, 0.3, 0.6, 1.2, 2), "revisions": (1.5, 2.5, 3.5, 6.5, 12),
    "kept": (0.5, 0.7, 0.8, 0.85, 0.88, 0.91, 0.94, 0.96, 0.985), "lost": (0.005, 0.015, 0.03, 0.06, 0.1, 0.15, 0.3), "loc": (50, 200, 1000, 4000),
    "dense": (0.001, 0.01, 0.03, 0.1), "longest": (200, 400, 1000, 5000), "width": (20, 30, 40, 60, 300),
}
MODEL_FIGURES = ("entropy", "diversity", "oddity", "length", "odd_path", "digits")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))), F.lit("other"))


class Text:
    """The bytes of a column of texts as one array, with row starts, so that a batch is cut into names without a loop."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = pc.fill_null(column, "")
        if column.offset:
            column = pa.concat_arrays([column])
        self.n = len(column)
        _, at, data = column.buffers()
        self.at = np.frombuffer(at, dtype=np.int64)[: self.n + 1]
        size = int(self.at[-1])
        self.b = np.frombuffer(data, dtype=np.uint8)[:size].astype(np.int64) if data and size else np.zeros(0, dtype=np.int64)
        self.fresh = np.zeros(size + 1, dtype=bool)
        self.fresh[self.at[:-1][self.at[:-1] < size]] = True

    def row(self, i: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, i, "right") - 1

    def runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs of bytes of equal positive kind, never across rows; bytes of negative kind stand alone."""
        if not len(kind):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        new = np.ones(len(kind), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] < 0) | self.fresh[1 : len(kind)]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(kind))
        keep = kind[at] != 0
        return at[keep], end[keep]

    def hashes(self, start: np.ndarray, end: np.ndarray, digits: bool = False) -> np.ndarray:
        """A 64-bit hash of the lower-case bytes of each run, from one prefix sum; with ``digits``, all digits count as 0."""
        c = _LOWER[self.b] if not digits else np.where(_DIGIT[self.b], 48, _LOWER[self.b]).astype(np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(c) + 1, _BASE, dtype=np.uint64))
            back = np.cumprod(np.full(len(c) + 1, _INVERSE, dtype=np.uint64))
            total = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(c * power[:-1]))
            return _mixed((total[end] - total[start]) * back[start])

    def comments(self) -> np.ndarray:
        """For each byte, whether its line opens as a comment does."""
        size = len(self.b)
        if not size:
            return np.zeros(0, dtype=bool)
        line = self.fresh[:size].copy()
        line[1:] |= self.b[:-1] == 10
        line[0] = True
        starts = np.flatnonzero(line)
        solid = np.append(np.flatnonzero(~_SPACE[self.b]), size - 1)
        first = solid[np.minimum(np.searchsorted(solid, starts), len(solid) - 1)]
        one, two = self.b[first], self.b[np.minimum(first + 1, size - 1)]
        said = np.isin(one, [35, 42, 59]) | ((one == 47) & np.isin(two, [47, 42])) | ((one == 45) & (two == 45)) | ((one == 60) & (two == 33)) | ((one == 34) & (two == 34))
        return said[np.cumsum(line) - 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Names:
    """The identifiers of a column of texts: outside comments if ``code``; else every piece between signs."""

    def __init__(self, column: pa.Array, code: bool = True):
        t = self.text = Text(column)
        kind = _NAME[t.b].astype(np.int64)
        if code:
            kind &= ~t.comments()
        a, e = t.runs(kind)
        number = _DIGIT[t.b[a]] if len(a) else np.zeros(0, dtype=bool)
        rows = t.row(a)
        self.numbers = np.bincount(rows[number], minlength=t.n)
        self.start, self.end, self.row = a[~number], e[~number], rows[~number]
        self.count = np.bincount(self.row, minlength=t.n)
        self.length = self.end - self.start

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(trigram, name it belongs to) of every sign of every name, and of its end."""
        k, n = self.start, self.length
        if not len(k):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        name = np.repeat(np.arange(len(k)), n + 1)
        pos = np.arange(len(name)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
        at = np.repeat(k, n + 1) + pos
        sign = np.append(_SIGN[self.text.b], END)
        last = pos == n[name]
        here = np.where(last, END, sign[np.minimum(at, len(sign) - 1)])
        one = np.where(pos >= 1, sign[np.maximum(at - 1, 0)], FIRST)
        two = np.where(pos >= 2, sign[np.maximum(at - 2, 0)], FIRST)
        return (two * SIGNS + one) * SIGNS + here, name

    def styles(self) -> np.ndarray:
        """0 flat, 1 camel, 2 Pascal, 3 UPPER, 4 snake, 5 mixed."""
        if not len(self.start):
            return np.zeros(0, dtype=np.int64)
        b = self.text.b
        flag = np.where((b >= 97) & (b <= 122), 1, np.where((b >= 65) & (b <= 90), 2, np.where(b == 95, 4, 0)))
        # reduceat wants ends between the starts; a closing zero keeps runs apart
        edges = np.stack([self.start, self.end], axis=1).ravel()
        got = np.bitwise_or.reduceat(np.append(flag, 0), np.minimum(edges, len(flag)))[::2]
        head = flag[self.start]
        return np.select(
            [got <= 1, (got == 3) & (head == 1), (got == 3) & (head == 2), (got & 1) == 0, (got & 2) == 0], [0, 1, 2, 3, 4], 5
        ).astype(np.int64)


def _per_row(x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=x, minlength=n)


class Models:
    """Trigram and style counts per language: one row of ROW numbers each, whatever the input."""

    def __init__(self, counts: np.ndarray):
        tri = counts[:, : SIGNS**3].reshape(len(_LANGS), SIGNS * SIGNS, SIGNS).astype(float)
        self.bits = -np.log2((tri + 0.1) / (tri.sum(axis=2, keepdims=True) + 0.1 * SIGNS))
        seen = tri.sum(axis=(1, 2))
        self.mean = np.where(seen > 0, (tri * self.bits).sum(axis=(1, 2)) / np.maximum(seen, 1), 0.0)
        self.bits = self.bits.reshape(len(_LANGS), -1)
        style = counts[:, SIGNS**3 :].astype(float)
        self.style = -np.log2((style + 1) / (style.sum(axis=1, keepdims=True) + 6))

    def entropy(self, lang: np.ndarray, names: Names, worst: bool = False) -> np.ndarray:
        """Bits a sign of the names of each row over the language's own mean (of the oddest name, if ``worst``); NaN without names."""
        g, name = names.grams()
        bits = self.bits[lang[names.row][name], g] if len(g) else np.zeros(0)
        n = names.text.n
        if not worst:
            signs = np.bincount(names.row[name], minlength=n) if len(g) else np.zeros(n)
            total = _per_row(bits, names.row[name], n) if len(g) else np.zeros(n)
            return np.where(signs > 0, total / np.maximum(signs, 1) - self.mean[lang], np.nan)
        out = np.full(n, -np.inf)
        if len(g):
            each = np.bincount(name, weights=bits, minlength=len(names.start)) / (names.length + 1)
            np.maximum.at(out, names.row, each)
        return np.where(np.isinf(out), np.nan, out - self.mean[lang])

    def oddity(self, lang: np.ndarray, names: Names) -> np.ndarray:
        """Bits a name of the naming styles."""
        total = _per_row(self.style[lang[names.row], names.styles()], names.row, names.text.n)
        return np.where(names.count > 0, total / np.maximum(names.count, 1), np.nan)


def _codes(lang: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(lang, pa.array(_LANGS)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def train(files: DataFrame) -> Models:
    """Counts over the identifiers of every head, per language, added up map-side; at most languages x ROW numbers are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(_LANGS) * ROW, dtype=np.int64)
        for b in batches:
            names, lang = Names(b.column(1)), _codes(b.column(0))
            g, name = names.grams()
            if len(g):
                seen += np.bincount(lang[names.row][name] * ROW + g, minlength=len(seen))
                seen += np.bincount(lang[names.row] * ROW + SIGNS**3 + names.styles(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["key", "n"])

    counts = files.where("head IS NOT NULL").select("lang", "head").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(_LANGS) * ROW, dtype=np.int64)
    out[counts["key"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return Models(out.reshape(len(_LANGS), ROW))


def _slot(zone: int, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (MEASURES + (_mixed(h + np.uint64(zone * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(SLOTS - MEASURES))).astype(np.int64)


def _path_evidence(paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): each directory whole and as 4-grams with its rims, and the pieces of the file name."""
    t = Text(pc.binary_join_element_wise("", paths, "/"))
    slash = t.b == 47
    a, e = t.runs(np.where(slash, 0, 1))
    row = t.row(a)
    file = np.append(row[1:] != row[:-1], True) if len(a) else np.zeros(0, dtype=bool)
    rows, slots = [row[~file]], [_slot(1, t.hashes(a[~file], e[~file], digits=True))]
    until = np.zeros(t.n, dtype=np.int64)
    until[row[file]] = a[file]
    if len(t.b) >= 4:
        p = np.arange(len(t.b) - 3)
        r = t.row(p)
        fits = (p + 4 <= until[r]) & ~slash[1:-2] & ~slash[2:-1]
        rows.append(r[fits])
        slots.append(_slot(2, t.hashes(p[fits], p[fits] + 4, digits=True)))
    part = np.where(np.isin(t.b, [46, 95, 45, 126, 64, 47]), 0, 1)
    inside = np.arange(len(t.b)) >= until[t.row(np.arange(len(t.b)))] if len(t.b) else np.zeros(0, dtype=bool)
    a, e = t.runs(part * inside)
    row = t.row(a)
    first = np.append(True, row[1:] != row[:-1]) if len(a) else np.zeros(0, dtype=bool)
    h = _slot(3, t.hashes(a, e, digits=True))
    rows.append(row)
    slots.append(np.where(first, np.where(e - a < 4, _slot(4, t.hashes(a, e, digits=True)), MEASURES - 1), h))
    return np.concatenate(rows), np.concatenate(slots)


def _comment_evidence(heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): words, numbers and signs of comment lines, alone and with the next one of the line."""
    t = Text(heads)
    if not len(t.b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = np.where(_LETTER[t.b], 1, np.where(_DIGIT[t.b], 2, np.where(_SPACE[t.b] | (t.b == 95), 0, -1)))
    a, e = t.runs(np.where(t.comments(), kind, 0))
    h = t.hashes(a, np.where(_DIGIT[t.b[a]], a + 1, e) if len(a) else e, digits=True)
    row, line = t.row(a), np.cumsum(np.append(t.b == 10, False))[a]
    pair = np.flatnonzero((row[1:] == row[:-1]) & (line[1:] == line[:-1]))
    with np.errstate(over="ignore"):
        both = h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]
    return np.concatenate([row, row[pair]]), np.concatenate([_slot(5, h), _slot(6, both)])


def _number(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def figures(b: dict[str, pa.Array], q: Models) -> dict[str, np.ndarray]:
    """The model figures and measures of a batch, NaN where there is nothing to measure."""
    lang, names = _codes(b["lang"]), Names(b["head"])
    n = np.maximum(names.count, 1)
    some = names.count > 0
    h = names.text.hashes(names.start, names.end)
    order = np.lexsort((h, names.row))
    hs, rs = h[order], names.row[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])) if len(hs) else np.zeros(0, dtype=bool)
    distinct = np.bincount(rs[new], minlength=len(lang))
    m = {c: _number(b[c]) for c in ("revisions", "added", "deleted", "loc", "complexity", "n_bytes", "longest_line")}
    least = lambda x: np.maximum(x, 1)
    with np.errstate(invalid="ignore"):
        return {
            "entropy": q.entropy(lang, names), "diversity": np.where(some, distinct / n, np.nan), "oddity": q.oddity(lang, names),
            "length": np.where(some, _per_row(names.length.astype(float), names.row, len(lang)) / n, np.nan),
            "odd_path": q.entropy(lang, Names(b["path"], code=False), worst=True),
            "digits": names.numbers / (names.count + 1), "revisions": m["revisions"], "kept": m["loc"] / least(m["added"]), "lost": m["deleted"] / least(m["added"]),
            "loc": m["loc"], "dense": m["complexity"] / least(m["loc"]), "longest": m["longest_line"], "width": m["n_bytes"] / least(m["loc"]),
        }


def evidence(files: DataFrame, models: Models, without: tuple[str, ...] = ()) -> DataFrame:
    """(repo, path, figures of BINS, slots, start) per file; ``without`` leaves out figures, or ``names`` for all names and words (tests)."""
    shared = files.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            b = dict(zip(batch.schema.names, batch.columns))
            f = figures(b, q)
            n = batch.num_rows
            rows, slots = [], []
            for k, (name, edges) in enumerate(BINS.items()):
                if name not in without:
                    there = np.flatnonzero(~np.isnan(f[name]))
                    rows.append(there)
                    slots.append(k * 16 + np.searchsorted(edges, f[name][there]))
            if "names" not in without:
                for r, s in (_path_evidence(b["path"]), _comment_evidence(b["head"])):
                    rows.append(r)
                    slots.append(s)
            key = np.unique(np.concatenate(rows) * SLOTS + np.concatenate(slots))
            row, slot = key // SLOTS, key % SLOTS
            at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            with np.errstate(invalid="ignore"):
                whole = (f["revisions"] <= YOUNG) & (f["kept"] >= WHOLE)
                typed = (f["revisions"] > OLD) & (f["lost"] > REWORKED)
            start = np.where(whole, START["whole"], np.where(typed, START["typed"], START["open"]))
            yield pa.RecordBatch.from_arrays(
                [b["repo"], b["path"], *[pa.array(f[c].astype(np.float32), from_pandas=True) for c in BINS], pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32))), pa.array(start)],
                ["repo", "path", *BINS, "slots", "start"],
            )

    return files.mapInArrow(run, f"repo string, path string, {', '.join(f'{c} float' for c in BINS)}, slots array<int>, start double")


def _log_odds(slots: pa.ListArray, weights: np.ndarray, prior: float) -> np.ndarray:
    at = slots.offsets.to_numpy()
    total = np.append(0.0, np.cumsum(weights[slots.values.to_numpy()]))
    return total[at[1:]] - total[at[:-1]] + prior


def mixture(seen: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weight per slot, prior) in log odds of not being hand-written, after ``rounds`` of expectation maximisation over all files.

    A round is one pass: each partition adds up what its files give to every slot, at most SLOTS sums reach the driver.
    """

    def sums(model: tuple[np.ndarray, float] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yes, no = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
            for b in batches:
                s = b.column(0)
                s = pa.concat_arrays([s]) if s.offset else s
                r = b.column(1).to_numpy() if model is None else 1 / (1 + np.exp(-np.clip(_log_odds(s, *model), -30, 30)))
                at = s.offsets.to_numpy()
                each, slot = np.repeat(r, np.diff(at)), s.values.to_numpy()[at[0] : at[-1]]
                yes[:SLOTS] += np.bincount(slot, weights=each, minlength=SLOTS)
                no[:SLOTS] += np.bincount(slot, weights=1 - each, minlength=SLOTS)
                yes[SLOTS] += r.sum()
                no[SLOTS] += (1 - r).sum()
            k = np.flatnonzero(yes + no)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(yes[k]), pa.array(no[k])], ["slot", "yes", "no"])

        return run

    model = None
    for _ in range(rounds):
        got = seen.select("slots", "start").mapInArrow(sums(model), "slot bigint, yes double, no double").groupBy("slot").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toPandas()
        yes, no = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        k = got["slot"].to_numpy(dtype=np.int64)
        yes[k], no[k] = got["yes"], got["no"]
        p, q = yes[SLOTS], no[SLOTS]
        if p + q == 0:
            return np.zeros(SLOTS), 0.0
        weight = np.log((yes[:SLOTS] + 0.5 * p / (p + q)) / (p + 0.5)) - np.log((no[:SLOTS] + 0.5 * q / (p + q)) / (q + 0.5))
        weight[(yes + no)[:SLOTS] == 0] = 0.0
        weight[MEASURES:] *= TEMPER
        model = weight, float(np.log(p / q)) if p and q else 0.0
    return model


def scored(file_metrics: DataFrame, file_heads: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """One row per (repo, path): model figures, measures and ``score``, the log odds of not being hand-written.

    Rows without a path name no file and are left out. Redeliveries count once. Null measures and heads are no
    evidence either way; a file without a row in file_heads is judged by path and measures. Empty tables give no rows. What is
    typed and what is not is learnt from the given files, so a handful of files alone says little; a large estate says it well.
    """
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    m = file_metrics.where("path IS NOT NULL").groupBy(own("repo").alias("r"), "path").agg(
        F.first("repo").alias("repo"), *[F.max(c).alias(c) for c in ("revisions", "added", "deleted", "loc", "complexity")]
    )
    h = file_heads.where("path IS NOT NULL").groupBy(own("repo").alias("r"), "path").agg(F.max("head").alias("head"), F.max("n_bytes").alias("n_bytes"), F.max("longest_line").alias("longest_line"))
    files = m.join(h, ["r", "path"], "left").withColumn("lang", language(F.col("path"))).drop("r")
    seen = written(evidence(files, train(file_heads.where("path IS NOT NULL").select("head", language(F.col("path")).alias("lang"))), without), "evidence", **PACKED)
    shared = files.sparkSession.sparkContext.broadcast(mixture(seen))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.schema.get_field_index("slots"))
            s = pa.concat_arrays([s]) if s.offset else s
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(_log_odds(s, *shared.value))], [*b.schema.names[:-2], "score"])

    return seen.mapInArrow(judge, f"repo string, path string, {', '.join(f'{c} float' for c in BINS)}, score double")


def kind(x: DataFrame) -> DataFrame:
    """(repo, path, kind, score) of the files not written by hand; kind is what the models say of their names.

    Mangled: high cross-entropy of short names, or lines no one types: ``packed``. Hardly a name beside numbers: ``data``. A foreign naming
    style, or names unlike the language's: ``vendored``. Else the names are the estate's own, as from a template: ``generated``; so is a copied
    file whose head shows no names.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    mangled = yes((F.col("entropy") > 0.5) & (F.col("length") < 4)) | yes(F.col("width") > 300)
    why = F.when(mangled, "packed").when(yes(F.col("digits") > 1.2), "data").when(yes(F.col("oddity") > 2.0) | yes(F.col("entropy") > 0.5), "vendored").otherwise("generated")
    return x.where("score > 0").select("repo", "path", why.alias("kind"), "score")


def found(file_metrics: DataFrame, file_heads: DataFrame) -> DataFrame:
    """p1_found: (repo, path)."""
    return scored(file_metrics, file_heads).where("score > 0").select("repo", "path")
