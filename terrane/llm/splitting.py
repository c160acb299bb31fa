"""Splitting oversized documents at natural boundaries, by bounded-quantifier regex extraction over token classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import tokenizer

#: Classes of the place after a token, strongest first: paragraph, line, sentence, word, character; x: inside a character.
PARAGRAPH, LINE, SENTENCE, WORD, CHAR, INSIDE = "PLSWCx"
_STOPS, _WIDE_STOPS = ([ord(c) for c in x] for x in (".!?", "。！？｡"))
_BLANKS = np.array([i for i in range(0x3001) if chr(i).isspace()], dtype=np.uint32)


def classes(text: str, tokens: list[int], sizes: np.ndarray) -> tuple[str, np.ndarray]:
    """One sign per token for the boundary after it, and the character offset at which each token ends.

    A token that ends within a character has that character's start as its end and can't be cut after. ``sizes`` has the
    bytes of each token id. All in array operations, as long texts have tens of thousands of tokens.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    at = np.cumsum(sizes[tokens])
    begins = np.append((data & 0xC0) != 0x80, True)
    inside = ~begins[at]
    ends = np.cumsum(begins[:-1])[at - 1] - inside
    c = np.append(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), 0)
    last, nxt = c[ends - 1], c[ends]
    blank = lambda x: np.isin(x, _BLANKS)
    end = ends >= len(text)
    line = last == 10
    para = line & (nxt != 10) & (ends > 1) & (c[ends - 2] == 10)
    stop = np.isin(last, _WIDE_STOPS) | (np.isin(last, _STOPS) & blank(nxt) & ~end)
    word = (blank(nxt) & ~end) | blank(last)
    signs = np.select([inside, para, line, stop, word], [np.uint8(ord(x)) for x in (INSIDE, PARAGRAPH, LINE, SENTENCE, WORD)], np.uint8(ord(CHAR)))
    return signs.astype(np.uint8).tobytes().decode(), ends


def pattern(most: Column) -> Column:
    """The rest if it fits; else up to ``most`` tokens, to the strongest boundary in the latter half of that, else in the former; else to any character."""
    upto, half = (most - 1).cast("string"), F.greatest(F.ceil(most / 2) - 1, F.lit(0)).cast("string")
    alternatives = [F.concat(F.lit(".{1,"), most.cast("string"), F.lit("}$"))]
    for least, last in ((half, upto), (F.lit("0"), half)):
        alternatives += [F.concat(F.lit(".{"), least, F.lit(","), last, F.lit("}" + c)) for c in (PARAGRAPH, LINE, SENTENCE, WORD)]
    alternatives += [F.concat(F.lit(".{0,"), upto, F.lit("}[^" + INSIDE + "]")), F.concat(F.lit(".{1,"), most.cast("string"), F.lit("}"))]
    return F.concat_ws("|", *alternatives)


def split(
    documents: DataFrame, size_limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = tokenizer.DEFAULT
) -> DataFrame:
    """(doc_id, piece, first_char, last_char, n_tokens, text): pieces numbered from 0, character ranges [first, last).

    A document within its source's max_tokens is one piece. Else the first piece takes up to max_tokens and each later
    one begins overlap_tokens before the end of the one before. The limit with a null source holds for every source not
    listed and for null sources; without one, or with a null or non-positive limit, documents stay whole. An overlap that is
    null or negative is none; one of max_tokens or more is cut to max_tokens - 1. Null texts give no piece, empty ones
    one empty piece. A cut between two tokens leaves the tokens on both sides as they are, but for white space at the rim,
    which may join into fewer; so no piece is over the limit, and n_tokens is counted on the piece's own text.
    """
    limits = size_limits.groupBy("source").agg(F.min("max_tokens").alias("max_tokens"), F.max("overlap_tokens").alias("overlap_tokens"))
    rule = F.struct(F.col("max_tokens").alias("most"), F.col("overlap_tokens").alias("over"))
    listed = limits.where("source IS NOT NULL").select("source", rule.alias("own"))
    other = limits.where("source IS NULL").select(rule.alias("other"))
    if listed.count() <= 100_000:  # some 40 bytes each; more of them meet the documents by a shuffle
        listed = F.broadcast(listed)
    rest = other.first()
    default = F.struct(F.lit(rest["other"]["most"]).cast("int").alias("most"), F.lit(rest["other"]["over"]).cast("int").alias("over")) if rest else F.lit(None).cast("struct<most:int,over:int>")
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "source")
    docs = docs.join(listed, "source", "left").withColumn("rule", F.coalesce("own", default))
    most = F.when(F.col("rule.most") > 0, F.col("rule.most"))
    docs = docs.select("doc_id", "text", most.cast("int").alias("most"), F.greatest(F.least(F.coalesce("rule.over", F.lit(0)), most - 1), F.lit(0)).cast("int").alias("over"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = tokenizer.load(tokenizer_path), tokenizer.sizes(tokenizer_path)
        for b in batches:
            count, signs, ends = [], [], []
            for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = enc.encode_ordinary(t)
                n = len(got)
                s, e = classes(t, got, sizes) if m is not None and n > m else ("", [])
                count.append(n)
                signs.append(s)
                ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(count, pa.int32()), pa.array(signs, pa.string()), pa.array(ends, pa.list_(pa.int32()))],
                ["doc_id", "text", "most", "over", "n", "signs", "ends"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.mapInArrow(mark, f"doc_id {id_type}, text string, most int, over int, n int, signs string, ends array<int>")
    long_ = F.col("signs") != ""
    # The first piece may take all of max_tokens, the others what the overlap leaves; ^ tells them apart.
    head = F.expr("regexp_substr(signs, concat('^(?:', whole, ')'))")
    cutted = (
        marked.withColumn("whole", pattern(F.col("most"))).withColumn("later", pattern(F.col("most") - F.col("over")))
        .withColumn("head", F.when(long_, F.length(head)))
    )
    tails = F.expr("regexp_extract_all(substring(signs, head + 1), later, 0)")
    steps = F.when(long_, F.concat(F.array("head"), F.transform(tails, F.length)))
    # cut points as running sums; a piece starts ``over`` tokens before the cut, at the next whole character
    sized = cutted.withColumn("steps", steps).withColumn(
        "cuts", F.when(long_, F.aggregate("steps", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
    )
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to")))
    spans = F.when(long_, F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.struct(
        F.when(i == 1, 0).otherwise(F.greatest(F.element_at("cuts", i) - F.col("over"), F.lit(0))).alias("from"), F.element_at("cuts", i + 1).alias("to")
    ))).otherwise(whole)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text is sent here once and sliced by offset, however many pieces it has
        enc = tokenizer.load(tokenizer_path)
        for b in batches:
            out: list[tuple] = []
            ids, texts, signs, ends, spans_ = b.columns
            flat, edges = spans_.flatten(), spans_.offsets.to_numpy()
            froms, tos, base = flat.field(0).to_numpy(), flat.field(1).to_numpy(), edges[0]
            for i, (t, s) in enumerate(zip(texts.to_pylist(), signs.to_pylist())):
                at = ends[i].values.to_numpy(zero_copy_only=False) if s else None
                for k, j in enumerate(range(edges[i] - base, edges[i + 1] - base)):
                    start, stop = int(froms[j]), int(tos[j])
                    if not s:
                        out.append((i, k, 0, len(t), stop, t))
                        continue
                    while start and s[start - 1] == INSIDE:  # a start within a character moves on to its end, so the overlap never exceeds what was asked
                        start += 1
                    first, last = int(at[start - 1]) if start else 0, int(at[stop - 1])
                    piece, n = t[first:last], stop - start
                    if piece and (piece[-1].isspace() or piece[:2].isspace()):  # only runs of white space at a rim may join
                        n = len(enc.encode_ordinary(piece))
                    out.append((i, k, first, last, n, piece))
                    if len(out) >= 4096:
                        yield batch(ids, out)
                        out = []
            yield batch(ids, out)

    def batch(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        cols = [[x[j] for x in out] for j in range(6)]
        arrays = [pa.array(c, pa.int32()) for c in cols[1:5]]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *arrays, pa.array(cols[5], pa.string())], ["doc_id", "piece", "first_char", "last_char", "n_tokens", "text"])

    made = sized.select("doc_id", "text", "signs", "ends", spans.alias("spans"))
    return made.mapInArrow(emit, f"doc_id {id_type}, piece int, first_char int, last_char int, n_tokens int, text string")
