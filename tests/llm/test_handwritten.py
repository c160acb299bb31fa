import random

import pyarrow as pa
import pytest
from conftest import rows

from terrane.llm import handwritten

M = "repo string, path string, revisions bigint, added bigint, deleted bigint, loc bigint, complexity double"
H = "repo string, path string, head string, n_bytes bigint, longest_line bigint"
NOUNS = "order seat voucher planner codec ledger tariff claim refund invoice session booking parcel".split()
VERBS = "price reject settle import archive release".split()


def corpus(n=900, seed=3):
    """Typed files, some of which only speak of tools and copies, and files made by a tool, copied in, packed or holding data."""
    g = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = g.sample(NOUNS, 3)
        code = f"package io.acme.{a};\n\nimport io.acme.{b}.{c.title()};\n\npublic class {c.title()}{b.title()} {{"
        loc = g.randint(40, 900)
        hand = (g.randint(1, 40), int(loc * g.uniform(1.15, 2.5)), loc, loc / 25)
        tool = (1, loc + g.randint(0, 3), loc, loc / 25) if g.random() < 0.7 else (g.randint(4, 9), int(loc * 1.2), loc, None)
        kind = g.choices(["hand", "talk", "made", "copy", "packed"], [60, 15, 12, 9, 4])[0]
        path = f"src/main/java/io/acme/{a}/{b.title()}{c.title()}{k}.java"
        if kind == "hand":
            row = (path, hand, code, loc * 35, 120)
        elif kind == "talk":
            line = g.choice([f"// Lists what the {a} tool has made; this file is ours", f"// The vendor of {a} goods, not a copy"])
            row = (f"src/{g.choice(['vendors', 'generator'])}/{a}_{k}.java", hand, f"{line}\n{code}", loc * 35, 120)
        elif kind == "made":
            row = (f"target/made-sources/{a}/{b}{k}.stub.java", tool, f"// Code made by stubber 2.{k % 7}. DO NOT TOUCH.\n{code}", loc * 35, 120)
        elif kind == "copy":
            name = "".join(g.choice("zxqwvk") + g.choice("aeu") for _ in range(4))
            row = (f"vendored/{name}/core_{k}.java", tool, f"/* {name} 1.{k % 9}, (c) the {name} authors */\nint {name[:3]}_{name[3:6]}(int x_{name[:2]})", loc * 35, 120)
        else:
            row = (f"web/{a}.{k:05x}.pack.js", (1, 3, 3, 0.0), "!function(e,t){var n=9,r=t.q,o=e.x;", 90000, 80000)
        out.append((*row, kind not in ("hand", "talk")))
    return out


def frames(spark, files):
    m = [("r", p, r, added, max(0, added - loc), loc, cx) for p, (r, added, loc, cx), *_ in files]
    h = [("r", p, head, b, ll) for p, _, head, b, ll, _ in files]
    return spark.createDataFrame([*m, m[0], (None, None, 1, 1, 1, 1, 1.0)], M), spark.createDataFrame([*h, h[0], ("r", None, "x", 1, 1)], H)


def quality(got, files):
    true, got = {p for p, *_, case in files if case}, {r[0] for r in got}
    return len(true & got) / len(true), len(true & got) / max(len(got), 1)


@pytest.fixture(scope="module")
def learnt(spark):
    files = corpus()
    return files, *frames(spark, files)


def test_finds_what_no_one_typed(learnt, clash):
    files, m, h = learnt
    recall, precision = quality(handwritten.found(clash(m), clash(h)).select("path").collect(), files)
    assert recall >= 0.95 and precision >= 0.95


def test_the_name_models_carry_the_decision(learnt):
    files, m, h = learnt
    without = handwritten.scored(m, h, without=("names", *handwritten.MODEL_FIGURES)).where("score > 0").select("path").collect()
    recall, precision = quality(without, files)
    full, _ = quality(handwritten.found(m, h).select("path").collect(), files)
    assert min(recall, precision) < full - 0.15


def test_kinds_come_from_the_models(learnt):
    files, m, h = learnt
    got = {r["path"]: r["kind"] for r in handwritten.kind(handwritten.scored(m, h)).collect()}
    packed = [k for p, k in got.items() if p.startswith("web/")]
    assert packed and packed.count("packed") > 0.9 * len(packed)
    made = [k for p, k in got.items() if p.startswith("target/")]
    assert made.count("generated") > 0.6 * len(made)


def models(names, style_row=None):
    import numpy as np

    counts = np.zeros((len(handwritten._LANGS), handwritten.ROW), dtype=np.int64)
    n = handwritten.Names(pa.array([" ".join(names)]))
    g, _ = n.grams()
    lang = handwritten._LANGS.index("java")
    np.add.at(counts[lang], g, 1)
    np.add.at(counts[lang], handwritten.SIGNS**3 + n.styles(), 1)
    return handwritten.Models(counts), lang


def test_models_tell_mangled_and_foreign_from_typed():
    import numpy as np

    q, lang = models(["seatPlanner", "orderCodec", "rejectVoucher", "plannerSeat", "voucherCodec"] * 4)
    names = handwritten.Names(pa.array(["seatCodec voucherPlanner", "zq xk9 qqz", "kune_core lib_put", "", None]))
    e, o = q.entropy(np.full(5, lang), names), q.oddity(np.full(5, lang), names)
    assert e[0] < e[1] and o[0] < o[2] and np.isnan(e[3]) and np.isnan(o[4])


def test_names_are_cut_as_a_plain_scan_cuts_them():
    import re

    texts = ["var a_b = 0x1f + c9;\n// do not edit me\n  # nor me\nfoo(Bar, x2)", None, "", "é日本 name", "ab " * 50000, "x" * 300000]
    n = handwritten.Names(pa.array(texts))
    got = [[] for _ in texts]
    data = b"".join((t or "").encode() for t in texts)
    for a, e, r in zip(n.start, n.end, n.row):
        got[r].append(data[a:e].decode())
    plain = lambda t: [w for line in (t or "").split("\n") if not re.match(r"\s*(//|#)", line) for w in re.findall(r"[\w$]+", line) if not w[0].isdigit()]
    assert got == [plain(t) for t in texts]
    assert list(n.numbers) == [1, 0, 0, 0, 0, 0]


def test_equal_words_hash_alike_wherever_they_stand():
    t = handwritten.Text(pa.array(["seat Seat", "", "x seat9 seat8"]))
    a, e = t.runs(handwritten._NAME[t.b].astype(int))
    h = t.hashes(a, e, digits=True)
    assert h[0] == h[1] and h[3] == h[4] and h[0] != h[2] != h[3]


def test_files_without_heads_nulls_and_empty_tables(spark, learnt):
    files, m, _ = learnt
    none = spark.createDataFrame([], H)
    assert handwritten.scored(m, none).count() == len(files)
    bare = spark.createDataFrame([("r", "src/x.java", *[None] * 5), (None, "src/x.java", *[None] * 5)], M)
    assert rows(handwritten.scored(bare, none).select("repo", "path")) == [("r", "src/x.java"), (None, "src/x.java")] or handwritten.scored(bare, none).count() == 2
    assert handwritten.found(spark.createDataFrame([], M), none).count() == 0
