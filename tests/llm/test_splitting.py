import random

from terrane.llm import splitting, tokenizer

D = "doc_id bigint, source string, text string"
L = "source string, max_tokens int, overlap_tokens int"
ENC = tokenizer.load()


def cut(spark, docs, limits, extra=lambda d: d):
    got = splitting.split(extra(spark.createDataFrame(docs, D)), spark.createDataFrame(limits, L)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        out.setdefault(r.doc_id, []).append(r)
    return out


def check(text, pieces, most, over):
    at = 0
    for k, p in enumerate(pieces):
        assert p.piece == k and p.text == text[p.first_char : p.last_char]
        assert p.n_tokens == len(ENC.encode_ordinary(p.text)) <= most
        if k:
            shared = len(ENC.encode_ordinary(text[p.first_char : at]))
            assert p.first_char <= at and shared <= over and (shared >= over - 4)
        at = p.last_char
    assert at == len(text) and pieces[0].first_char == 0


def test_limits_overlap_and_round_trip(spark, clash):
    rnd = random.Random(3)
    words = "the quick Grüße 障害の原因 naïve 🙂🙂 lazily, dog. Why? ok!\n x\n\n para\n\n\n".split(" ")
    docs = [(k, "a", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400)))) for k in range(12)]
    docs += [(50, "a", "x" * 3000), (51, "a", " " * 3000), (52, "a", "\n" * 500), (53, "a", "障" * 700), (54, "a", "🙂" * 300)]
    got = cut(spark, docs, [("a", 40, 9)], clash)
    for k, _, text in docs:
        check(text, got[k], 40, 9)
    assert all(len(v) == 1 for k, v in got.items() if len(ENC.encode_ordinary(docs[k][2] if k < 12 else "x" * 999)) <= 40)


def test_strongest_boundary_wins(spark):
    text = "one two three. four five six\n\nseven eight nine. ten eleven twelve thirteen fourteen"
    got = cut(spark, [(1, "a", text)], [("a", 12, 0)])[1]
    assert got[0].text.endswith("\n\n") and got[1].text.startswith("seven")


def test_rules_of_the_limits(spark):
    text = "word " * 100
    docs = [(1, "a", text), (2, "zz", text), (3, None, text), (4, "off", text), (5, "wide", text), (6, "a", None), (7, "a", ""), (7, "a", "")]
    got = cut(spark, docs, [("a", 30, None), (None, 50, 5), ("off", None, 3), ("wide", 20, 99), ("a", 40, -1)])
    assert 6 not in got and got[7][0].n_tokens == 0 and len(got[7]) == 2 and len(got[4]) == 1
    check(text, got[1], 30, 0)
    check(text, got[2], 50, 5)
    check(text, got[3], 50, 5)
    check(text, got[5], 20, 19)


def test_no_default_and_empty_tables(spark):
    assert len(cut(spark, [(1, "b", "word " * 100)], [("a", 10, 0)])[1]) == 1
    assert len(cut(spark, [(1, "b", "word " * 100)], [])[1]) == 1
    assert cut(spark, [], [("a", 10, 0)]) == {}


def test_classes_agree_with_the_text():
    text = "Ab 障害。\n\nx🙂. y"
    signs, ends = splitting.classes(text, ENC.encode_ordinary(text), tokenizer.sizes())
    assert len(signs) == len(ends) == len(ENC.encode_ordinary(text)) and ends[-1] == len(text)
    assert all(a <= b for a, b in zip(ends, ends[1:]))
