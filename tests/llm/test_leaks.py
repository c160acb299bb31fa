import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import leaks

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
ITEM = " ".join(WORDS[:40]) + ". Say why and be brief."
OTHER = " ".join(WORDS[40:64]) + ". Say why and be brief."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=120), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_index_finds_what_a_scan_finds(text, phrases):
    index = leaks.FMIndex(np.array(text, dtype=np.int64), sample=4)
    width = max(map(len, phrases))
    table = np.zeros((len(phrases), width), dtype=np.int64)
    for i, p in enumerate(phrases):
        table[i, width - len(p) :] = p
    lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    for i, p in enumerate(phrases):
        want = [k for k in range(len(text) - len(p) + 1) if text[k : k + len(p)] == p]
        got = sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) if hi[i] > lo[i] else []
        assert got == want


def find(spark, docs, items=((1, ITEM), (2, OTHER)), extra=lambda d: d):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(list(items), "item_id bigint, text string")
    return rows(leaks.found(extra(d), extra(i)))


def test_forms_of_a_leak(spark, clash):
    w = WORDS
    span = w[5:27]
    changed = span[:7] + ["xx"] + span[8:15] + ["yy"] + span[16:]
    docs = [
        (1, "before " + " ".join(span) + " after"), (2, " ".join(x.upper() for x in span)), (3, "\n".join("// " + " ".join(span[k : k + 5]) for k in range(0, 22, 5))),
        (4, '{"t": "' + "\\n".join(span) + '"}'), (5, "<p>" + " ".join(f"<b>{x}</b>" for x in span) + "</p>"), (6, " ".join(x[0] + "​" + x[1:] for x in span)),
        (7, " ".join(changed)), (8, " ".join(span[:10] + ["more"] + span[10:])), (9, "| " + " | ".join(span) + " |"), (10, "&amp;".join(span)),
        (11, " ".join(span[:19])),  # too short
        (12, " ".join(x if k % 5 else "zz" for k, x in enumerate(w[:40]))),  # too much changed
        (13, "Say why and be brief. " * 9),  # a sentence of several items
        (14, None), (15, ""), (16, " ".join(["filler"] * 60000) + " " + " ".join(span)), (17, " ".join(w[2:40] + w[40:64])),
    ]
    got = find(spark, docs, extra=clash)
    assert set(got) == {(k, 1) for k in [*range(1, 11), 16, 17]} | {(17, 2)}


def test_repeats_ties_and_empty_tables(spark):
    text = " ".join(WORDS[:25])
    assert find(spark, [(1, text), (1, text), (2, text)], [(1, ITEM), (1, ITEM), (3, None), (4, "short one")]) == [(1, 1), (2, 1)]
    assert find(spark, [(1, text)], [(1, text), (2, text)]) == []  # one sentence of two items counts for neither
    assert find(spark, []) == []
    assert leaks.found(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_spans_merge(spark):
    d = spark.createDataFrame([(1, "x " + " ".join(WORDS[:24]) + " " + " ".join(WORDS[:24]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    (doc, first, last, n), = rows(leaks.removal_spans(d, i))
    text = d.first()["text"]
    assert (doc, n) == (1, 1) and leaks.tokens(text[first:last]) == leaks.tokens(text)[1:49]
    assert rows(leaks.found(spark.createDataFrame([(1, text[:first] + text[last:])], d.schema), i)) == []


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs = [(1, " ".join(WORDS[:25])), (2, " ".join(WORDS[40:62]))]
    whole = find(spark, docs)
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    assert find(spark, docs) == whole == [(1, 1), (2, 2)]


@pytest.mark.parametrize("text,want", [("A_b-c", [b"a", b"b", b"c"]), ("café Ａ", ["café".encode(), b"a"]), ("\\u0041b", [b"ab"])])
def test_tokens(text, want):
    assert leaks.tokens(text) == want


def test_places_cut_the_text_as_it_stands():
    texts = ["Café &amp; x &#233;t <b>bo</b>ld \\u0041bc \\n z\u200by ｶﾞ İI e\u0301", "plain text", "<" + "a" * 900 + "> b", "", "🙂 a_b"]
    for t in texts:
        got = leaks.places(t)
        assert len(got) == len(leaks.tokens(t)) and all(0 <= i < j <= len(t) for i, j in got) and got == sorted(got)
    assert [texts[0][i:j] for i, j in leaks.places(texts[0])][3:6] == ["bo</b>ld", "\\u0041bc", "z\u200by"]
