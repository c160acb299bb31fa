from collections import defaultdict

from conftest import rows

from terrane.llm import names

ENTITIES = [
    ["Johannes Begéhegul", "Begéhegul, Johannes", "hannes.begehegul@mail.example", "begehegulj", "JOHANNES BEGÉHEGUL", "Johannes Begéhegul", "Johannes Begéheul", "Dr. Johannes Begéhegul", "Johannes Begéhegul (export)", "J. Begehegul"],
    ["Michael Gikukifil", "Mike Gikukifil", "Gikukifil, Michael", "MichaelGikukifil"],
    ["Mehmet Gikukifil", "mehmet-gikukifil", "Mehmet W. Gikukifil", "Mehmet Gikukifil [ext]"],
    ["Wokasusu Consulting GmbH", "WOKASUSU CONSULTING", "Wokasusu (Consulting) GmbH", "dev@wokasusu-consulting.example", "wokasusu-consulting", "Wokasusu Cons. GmbH"],
    ["Wokasusu Software AG", "Wokasusu SW"],
    ["Nadège von Vihuwawun", "nvonvihuwawun", "NadegeVonvihuwawun"],
    ["ci-build"],
]


def link(spark, values, other=(), extra=lambda d: d):
    own = spark.createDataFrame([(v,) for v in values], "author string")
    fm = spark.createDataFrame([(v,) for v in other], "main_author string")
    return rows(names.found(extra(own), extra(fm)))


def test_entities(spark, clash):
    all_ = [v for e in ENTITIES for v in e]
    got = link(spark, [*all_, *all_[:5], None, "", "  "], [all_[0], None], clash)
    want = sorted((min(a, b), max(a, b)) for e in ENTITIES for i, a in enumerate(e) for b in e[i + 1 :])
    assert set(got) == set(want) and len(got) == len(want)


def test_initials_that_fit_two_people_stand_alone(spark):
    got = link(spark, ["Michael Gikukifil", "Mehmet Gikukifil", "M. Gikukifil"])
    assert got == []


def test_brute_force_links(spark):
    """Every pair the verification accepts is found through the prefix filter."""
    vals = [v for e in ENTITIES for v in e] + [f"{g} {f}" for g in ("Anna", "Antonia", "Daniel") for f in ("Tivonubi", "Tivonuubi", "Navomelur", "Xedrican")]
    df = spark.createDataFrame([(v,) for v in sorted(set(vals))], "name string")
    got = {(a, b) for a, b, _ in rows(names.links(df))}
    parsed = {v: names.parse(v) for v in set(vals)}
    import math
    count = defaultdict(int)
    for p in parsed.values():
        for t in set(p[1]):
            count[t] += 1
    w = {t: math.log(1 + len(parsed) / n) for t, n in count.items()}
    want = {(a, b) for a in parsed for b in parsed if a < b and names.similarity(parsed[a], parsed[b], w, w)[0] >= names.THRESHOLD}
    assert got == want


def test_edges(spark):
    assert link(spark, []) == []
    assert link(spark, ["x" * 5000, "Q", "...", "@", "<>", "()", "[ext]", ", ", "-"]) == []
    assert link(spark, ["Anna Novak", "Anna Novak "]) == [("Anna Novak", "Anna Novak ")]


def test_osa():
    assert names.osa("lafabatan", "lafabatna") == 1 and names.osa("abc", "abcd") == 1 and names.osa("abcd", "badc") == 2 and names.osa("", "ab") == 2


def against_brute_force(spark, vals):
    import math

    parsed = {v: names.parse(v) for v in set(vals)}
    got = {(a, b) for a, b, _ in rows(names.links(spark.createDataFrame([(v,) for v in sorted(parsed)], "name string")))}
    count = defaultdict(int)
    for p in parsed.values():
        for t in set(p[1]):
            count[t] += 1
    w = {t: math.log(1 + len(parsed) / n) for t, n in count.items()}
    want = {(a, b) for a in parsed for b in parsed if a < b and names.similarity(parsed[a], parsed[b], w, w)[0] >= names.THRESHOLD}
    assert got == want
    return got


CROWD = [a + b for a in ("Rake", "Suvi", "Toma", "Liwo", "Nedu") for b in ("rol", "xin", "berd", "gusta", "pemil", "zand", "fyk", "hoven", "quist", "jala")]


def test_links_under_a_common_surname(spark):
    """More than 40 names share it: initials, pet names, logins and mistyped forms are still found."""
    vals = [f"{g} Mueller" for g in CROWD] + ["Anna Mueller", "A. Mueller", "Mueller, A.", "Hanna Mueller", "Anan Muller", "Bob Mueller", "Robert Mueller", "R. Mueller", "amuller", "mullerb", "A. Mueler", "Anna Mueler", "Ana Mueler"]
    vals += ["Konstantinos Mueller", "Kontsantinso Mueller", "Anna F. Mueller", "Mueller Software GmbH", "Muller SW", "Mueler Software"]
    got = against_brute_force(spark, vals)
    assert {("A. Mueller", "Anna Mueller"), ("Bob Mueller", "Robert Mueller"), ("Anna Mueller", "amuller"), ("A. Mueler", "Anna Mueller")} <= got


def test_links_where_the_rest_is_light(spark):
    """Nearly every name has the same given name, so it cannot part two names that share the other word."""
    vals = [f"Anna Maria {g}" for g in CROWD] + [f"Anna {g} Mueller" for g in CROWD] + ["Anna Mueller", "Maria Mueller", "Mueller, M.", "Anna Maria Mueller"]
    against_brute_force(spark, vals)


def test_links_of_short_surnames(spark):
    vals = ["Bob Lee", "Robert Lee", "B. Lee", "blee", "Lee, R.", "Li Wu", "L. Wu", "liwu", "Kim Ng", "K. Ng", "kng", "Bob L.", "Robert L.", "Jim Wu", "James Wu"]
    got = against_brute_force(spark, vals)
    assert {("Bob Lee", "Robert Lee"), ("B. Lee", "Bob Lee"), ("Bob Lee", "blee"), ("K. Ng", "Kim Ng"), ("Bob L.", "Robert L."), ("James Wu", "Jim Wu")} <= got
    against_brute_force(spark, vals + [f"{g} Lee" for g in CROWD])  # common and short


def test_entities_of_a_long_chain(spark):
    n = spark.createDataFrame([(f"n{k:03d}",) for k in range(130)], "name string")
    e = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(119)] + [("n125", "n126")], "name_a string, name_b string")
    got = {r["name"]: r["entity"] for r in names.components(n, e).collect()}
    assert got == {f"n{k:03d}": "n000" if k < 120 else "n125" if k == 126 else f"n{k:03d}" for k in range(130)}
