"""Variant spellings of typed names: prefix-filtered q-gram join of rare tokens, soft weighted verification, entities."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import cut

#: Short and pet forms of given names.
NICKNAMES = {
    "alexander": "alex sascha sasha lex xander sandy", "andreas": "andi andy dre", "antonia": "toni tonia", "benjamin": "ben benny benji",
    "christopher": "chris topher kit", "daniel": "dan danny dani", "dorothea": "thea dora dorle doro dorothy", "edward": "ed eddie ned ted teddy",
    "elizabeth": "liz beth betty lizzie eliza lisa bess", "francesca": "franca fran cesca frannie", "friedrich": "fritz fred freddy friedel",
    "gabriele": "gabi gaby", "jennifer": "jenny jen jenn", "johannes": "hannes hans johann jo", "joseph": "joe jo joey sepp",
    "katharina": "kathi katha kathy kati katja kate", "margaret": "maggie peggy meg greta marge", "michael": "mike mick micha michi",
    "nikolaus": "niko klaus nico nick", "priyanka": "priya", "robert": "rob bob bobby bert robbie", "samuel": "sam sammy",
    "susanne": "susi sanne suse susie", "theodore": "theo ted teddy", "thomas": "tom tommy", "victoria": "vicky tori vicki",
    "william": "will bill billy willy liam", "zofia": "zosia sofia", "olena": "lena olenka", "ingrid": "inga inka",
    "lars": "lasse", "yusuf": "yus", "hiroshi": "hiro",
    "james": "jim jimmy jamie", "john": "jack johnny", "richard": "rick dick rich", "charles": "charlie chuck", "henry": "harry hank",
    "anthony": "tony", "matthew": "matt", "patricia": "pat patty trish", "catherine": "cathy cat", "rebecca": "becky", "stephen": "steve",
    "david": "dave", "gregory": "greg", "jeffrey": "jeff", "kenneth": "ken", "timothy": "tim", "nicholas": "nicky", "philip": "phil", "peter": "pete",
}
#: Trades in the names of firms and their abbreviations; legal forms; titles; name particles; role mailboxes.
TRADES = {
    "software": "sw", "services": "svcs svc service", "systems": "sys syst system", "engineering": "eng engg", "consulting": "cons consultants",
    "technologies": "tech technology techn", "solutions": "sol solution", "logistics": "log logistic", "group": "grp", "international": "intl",
    "partners": "ptnrs", "industries": "ind", "networks": "nets", "labs": "laboratories", "digital": "dig", "data": "", "media": "",
}
LEGAL = set("gmbh ag inc ltd sa llc kg plc corp co bv nv oy ab srl spa se limited incorporated kgaa ohg mbh".split())
TITLES = set("dr prof mr mrs ms herr frau ing dipl phd sir msc bsc".split())
PARTICLES = set("van von de der den del la le da di du dos zu zur ten ter vom al el".split())
ROLES = set("dev build team info admin support contact mail office ops hello noreply".split())

_TRADE = {a: k for k, v in TRADES.items() for a in [k, *v.split()]}
_DIRECT = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "a", "Æ": "A", "œ": "o", "ı": "i", "þ": "th", "ð": "d"})


def fold(s: str) -> str:
    """Without diacritics; ae, oe and ue as the plain vowel, since umlauts are typed either way."""
    s = unicodedata.normalize("NFKD", s.translate(_DIRECT))
    s = "".join(c for c in s if unicodedata.category(c) != "Mn")
    return s


def _umlaut(t: str) -> str:
    return re.sub(r"([aou])e", r"\1", t)


def parse(name: str) -> tuple[str, list[str], list[str]]:
    """(kind, tokens, initials): kind is ``firm``, ``person``, ``login`` (one word) or ``plain`` (nothing to compare)."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
    if re.search(r"[^<\s].*<[^>]*>\s*$", s):
        s = re.sub(r"\s*<[^>]*>\s*$", "", s)
    s = s.strip("<>")
    if "@" in s and " " not in s:
        local, _, domain = s.partition("@")
        s = domain.split(".")[0] if local.lower() in ROLES else local
    s = re.sub(r'["“”][^"“”]*["“”]', " ", s)
    s = re.sub(r"\s*\[[^\]]*\]\s*$", "", s)
    tail = re.search(r"\s*\(([^)]*)\)\s*$", s)
    if tail and (fold(tail[1]).lower() not in _TRADE):
        s = s[: tail.start()]
    s = fold(re.sub(r"(?<=\w)['’](?=\w)", "", re.sub(r"[()\[\]]", " ", s))).strip()
    s = re.sub(r"\b([Ss])\.\s?([Aa])\.?(?=\s*$)", "SA", s)
    if re.fullmatch(r"[A-Z][a-z]+(?:[A-Z][a-z-]+)+", s):
        s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    before, comma, after = s.partition(",")
    raw = re.findall(r"[^\W_]+", s)
    if len(raw) > 1 and raw[-1].lower() in LEGAL and any(t.lower() in _TRADE for t in raw[:-1]):
        raw, comma = raw[:-1], ""
    low = [t.lower() for t in raw]
    trade = [t for i, t in enumerate(low) if t in _TRADE and (len(t) > 3 or i == len(low) - 1 or (i == 0 and len(low) > 1 and len(t) > 2)) and not comma]
    if trade and len(low) > 1:
        return "firm", [_umlaut(t) if t not in trade else _TRADE[t] for t in low if t in trade or t not in LEGAL], []
    shout = s.upper() == s
    if comma:
        given = re.findall(r"[^\W_]+", after)
        raw = given + re.findall(r"[^\W_]+", before)
    tokens, initials, held = [], [], ""
    for i, t in enumerate(raw):
        x = t.lower()
        if x in TITLES and len(raw) > 1:
            continue
        if i + 1 < len(raw) and (tokens + initials or len(raw) > 2) and (x in PARTICLES or (i and t.islower() and len(t) <= 4 and raw[i + 1][0].isupper())):
            held += x if x in PARTICLES else next((p for p in ("von", "van", "de") if osa(x, p) <= 1), x)
        elif len(x) == 1:
            initials.append(x)
        elif len(x) in (2, 3) and t.isupper() and not shout and len(raw) > 1:
            initials += list(x)
        else:
            tokens.append(_umlaut(held + x))
            held = ""
    if not tokens:
        return "plain", [], []
    if len(tokens) == 1 and not initials:
        return "login", tokens, []
    return "person", tokens, initials


_KNOWN: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _n in [_full, *_short.split()]:
        _KNOWN.setdefault(_umlaut(_n), set()).add(_full)
_NICK: dict[str, set[str]] = dict(_KNOWN)


def use(nicknames: bool) -> None:
    """Whether this process knows NICKNAMES; said by each task, as the list is a parameter of the operator."""
    _NICK.clear()
    if nicknames:
        _NICK.update(_KNOWN)


def osa(a: str, b: str, most: int = 1) -> int:
    """Edit distance with transpositions of neighbours; most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    p2, p1 = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(p1[j] + 1, row[j - 1] + 1, p1[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, p2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        p2, p1 = p1, row
    return p1[-1]


def alike(a: str, b: str) -> float:
    """Similarity of two tokens: equal or the same given name 1, one typing error 0.95, else 0."""
    if a == b or (_NICK.get(a, set()) & _NICK.get(b, set())):
        return 1.0
    if min(len(a), len(b)) >= 3 and osa(a, b) == 1:
        return 0.95
    if min(len(a), len(b)) >= 10 and osa(a, b, 2) == 2:
        return 0.9
    return 0.0


def starts(i: str, token: str) -> bool:
    """Whether an initial can stand for a token, be it for one of the full forms of a pet name."""
    return token[0] == i or any(f[0] == i for f in _NICK.get(token, ()))


THRESHOLD, SMALL = 0.88, 0.3


def similarity(a: tuple, b: tuple, wa: dict, wb: dict) -> tuple[float, str]:
    """(score, brief). The score is the share of token weight, both ways, that has a counterpart.

    brief tells which side stands for the other's given name by an initial only: ``a``, ``b``, ``ab`` or neither.
    """
    (ka, ta, ia), (kb, tb, ib) = a, b
    if "plain" in (ka, kb):
        return 0.0, ""
    if ka == kb == "login":
        return (1.0, "ab") if ta == tb else (0.0, "")
    for t, i, other, inits, side in ((ta, ia, tb, ib, "a"), (tb, ib, ta, ia, "b")):
        if i or "firm" in (ka, kb):
            continue
        word = "".join(t)
        if len(other) > 1 and len(t) < len(other) and word in ("".join(other), "".join(other[::-1])):
            return 1.0, ""
        if word in glued(other, inits):
            return 1.0, side + ("" if len(other) > 1 else "ba"[side == "b"])
    if "login" in (ka, kb) or (ka == "firm") != (kb == "firm"):
        return 0.0, ""
    used, brief, got, total = set(), set(), 0.0, 0.0
    left = []
    for t in sorted(ta, key=lambda x: -wa[x]):
        best, at = 0.0, None
        for j, u in enumerate(tb):
            if j not in used and (s := alike(t, u)) > best:
                best, at = s, j
        if at is None:
            left.append(t)
        else:
            used.add(at)
            w = wa[t] + wb[tb[at]]
            got, total = got + best * w, total + w
    right = [u for j, u in enumerate(tb) if j not in used]
    fa, fb = list(ia), list(ib)
    for rest, w, inits, side in ((left, wa, fb, "b"), (right, wb, fa, "a")):
        for t in rest:
            total += w[t]
            k = next((x for x in inits if starts(x, t)), None)
            if k is not None and used:
                inits.remove(k)
                got += 0.97 * w[t]
                brief.add(side)
    for x in list(fa):
        if x in fb:
            fa.remove(x)
            fb.remove(x)
            got, total = got + 2 * SMALL, total + 2 * SMALL
    if fa and fb:
        total += 4.0  # middle initials that contradict each other
    total += SMALL * (len(fa) + len(fb))
    if not left and not right and len(ta) == 1 == len(tb):
        brief = {"a", "b"}
        if not (set(ia) & set(ib)):
            return 0.0, ""
    return (got / total if total else 0.0), "".join(sorted(brief))


def glued(tokens: list[str], initials: list[str]) -> set[str]:
    """The one-word logins made of one initial and the other words."""
    out = set()
    for i, t in enumerate(tokens):
        rest = "".join(tokens[:i] + tokens[i + 1 :])
        if rest:
            for x in {t[0], *(f[0] for f in _NICK.get(t, ()))}:
                out |= {x + rest, rest + x}
    if len(tokens) == 1 and initials:
        out |= {initials[0] + tokens[0], tokens[0] + initials[0]}
    return {_umlaut(x) for x in out}


PARSED = (
    "name string, kind string, tokens array<string>, initials array<string>, word string, glued array<string>, "
    "spots array<struct<tok: string, own: string, named: array<string>, firsts: array<string>>>"
)


def forms(token: str) -> set[str]:
    """A token and the full forms it may be a pet name of, the latter marked, as none is typed."""
    return {token} | {f"={f}" for f in _NICK.get(token, ())}


def spots(tokens: list[str]) -> list[tuple]:
    """(key, token, named, firsts) of each token, short or long, and of each full form of it; the last two describe the tokens beside it.

    named: what an alike token of the other name has too, but for one typing error (two errors in a long token leave one of
    its first three signs among the first three of the other). firsts: the initials that can stand for one of them.
    """
    out = []
    for t in sorted({t for t in tokens if t not in TRADES} or set(tokens)):
        rest = list(tokens)
        rest.remove(t)
        named = {x for y in rest for x in forms(y)} | {f"<{c}" for y in rest if len(y) >= 10 for c in y[:3]}
        firsts = {c for y in rest for c in (y[0], *(f[0] for f in _NICK.get(y, ())))}
        out += [(k, t, sorted(named), sorted(firsts)) for k in sorted(forms(t))]
    return out


def _parsed(names: DataFrame, nicknames: bool) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(nicknames)
        for pdf in parts:
            rows = []
            for n in pdf["name"]:
                kind, tokens, initials = parse(n)
                word, one = None, set()
                if kind in ("person", "login"):
                    one = glued(tokens, initials) | {"".join(tokens), "".join(tokens[::-1])}
                    word = None if initials else "".join(tokens)
                rows.append((n, kind, tokens, initials, word, sorted(one), spots(tokens) if kind in ("person", "firm") else []))
            yield pd.DataFrame(rows, columns=["name", "kind", "tokens", "initials", "word", "glued", "spots"])

    return names.mapInPandas(run, PARSED)


def similar_tokens(tokens: DataFrame, q: int = 4) -> DataFrame:
    """(tok_a, tok_b): pairs of distinct tokens at most one typing error apart, both directions.

    Prefix filter: one error changes at most q + 1 of a token's padded q-grams, so among the q + 2 globally rarest grams of
    either token they share one, at positions at most one apart. Verified by edit distance.
    """
    pad = "#" * (q - 1)
    padded = F.concat(F.lit(pad), "tok", F.lit(pad))
    grams = tokens.select("tok", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, q))).alias("pos", "gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    prefix = grams.join(counts, "gram").groupBy("tok").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram", "pos"))), 1, q + 2).alias("p")).select("tok", F.length("tok").alias("len"), F.inline("p"))
    left = prefix.select(F.col("tok").alias("tok_a"), F.col("len").alias("la"), "gram", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("at"))
    right = prefix.select(F.col("tok").alias("tok_b"), F.col("len").alias("lb"), "gram", F.col("pos").alias("at"))
    near = left.join(right, ["gram", "at"]).where("tok_a < tok_b AND abs(la - lb) <= 1").select("tok_a", "tok_b").distinct()
    d = F.levenshtein("tok_a", "tok_b")
    swap = (F.length("tok_a") == F.length("tok_b")) & (d == 2) & (F.array_sort(F.split("tok_a", "")) == F.array_sort(F.split("tok_b", "")))
    near = near.where((d <= 1) | swap)
    return near.unionByName(near.select(F.col("tok_b").alias("tok_a"), F.col("tok_a").alias("tok_b")))


def links(names: DataFrame, nicknames: bool = True) -> DataFrame:
    """(name_a, name_b, brief) of verified pairs, name_a < name_b, from distinct non-blank (name)."""
    parsed = cut(_parsed(names, nicknames))
    total = parsed.count()
    df = parsed.select(F.explode(F.array_distinct("tokens")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    weigh = parsed.select("name", F.explode(F.array_distinct("tokens")).alias("tok")).join(df, "tok")
    weights = weigh.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("tok", F.log(1 + F.lit(float(total)) / F.col("df"))))).alias("w"))
    known = cut(parsed.join(weights, "name"))
    # A word that can be a login meets the names it can be glued from, whatever their keys.
    words = known.where("word IS NOT NULL").select(F.concat(F.lit("@"), "word").alias("block"), "name")
    pieces = known.select(F.explode(F.transform("glued", lambda x: F.concat(F.lit("@"), x))).alias("block"), "name")
    keyed = cut(
        known.select("name", "initials", "w", F.inline("spots"))
        .withColumn("weight", F.coalesce(F.try_element_at("w", F.col("own")), F.lit(0.0)))
        .withColumn("rest", F.aggregate(F.map_values("w"), F.lit(0.0), lambda a, x: a + x) - F.col("weight")).drop("w", "own")
    )
    # A key that few names share joins them alone. One that many share says little: it joins those that share something
    # else too, in any way in which similarity() lets two names agree. Mistyped forms are neighbours of both.
    keys = cut(keyed.groupBy("tok").agg(F.count("*").alias("n")))
    heads = keys.select("tok", (F.col("n") > F.greatest(F.lit(40), F.sqrt(F.lit(float(total))))).alias("hot"), F.log(1 + F.lit(float(total)) / F.col("n")).alias("head_weight"))
    near = cut(similar_tokens(known.where("kind IN ('person', 'firm')").select(F.explode("tokens").alias("tok")).distinct()))
    native = keyed.join(heads, "tok")
    heard = keyed.unionByName(keyed.join(near, keyed["tok"] == near["tok_a"]).drop("tok", "tok_a").withColumnRenamed("tok_b", "tok")).join(heads, "tok")
    mark = lambda m, c: F.transform(c, lambda x: F.concat(F.lit(m), x))
    block = lambda d, parts: d.select(F.explode(F.transform(parts, lambda x: F.concat_ws("|", "tok", x))).alias("block"), "name")
    # What is neither equal, mistyped nor an initial may still weigh too little to part two names: x (something light beside the key), 0 (nothing).
    most = (1 - THRESHOLD) / THRESHOLD
    light = lambda other: F.col("rest") <= most * (F.col("weight") + other) + 1e-9
    alone = F.abs("rest") < 1e-9
    plain_native = F.when(alone, F.array(F.lit("?0"))).when(light(F.lit(math.log(1 + max(total, 1)))), F.array(F.lit("?x"))).otherwise(F.array())
    plain_heard = F.when(alone, F.array(F.lit("?x"))).when(light(F.col("head_weight")), F.array(F.lit("?x"), F.lit("?0"))).otherwise(F.array())
    hot_native, hot_heard = native.where("hot"), heard.where("hot")
    typed = hot_heard.select("tok", "name", F.explode("named").alias("tok_a")).join(near, "tok_a")
    same = (
        native.where("NOT hot").select(F.col("tok").alias("block"), "name")
        .unionByName(block(hot_native, F.concat("named", mark("!", F.col("initials")), mark(".", F.col("firsts")), plain_native)))
        .unionByName(pieces).distinct()
    )
    spread = (
        heard.where("NOT hot").select(F.col("tok").alias("block"), "name")
        .unionByName(block(hot_heard, F.concat("named", mark("!", F.col("initials")), mark(".", F.col("initials")), plain_heard)))
        .unionByName(typed.select(F.concat_ws("|", "tok", "tok_b").alias("block"), "name"))
        .unionByName(words).distinct()
    )
    pairs = (
        spread.select("block", F.col("name").alias("name_a")).join(same.select("block", F.col("name").alias("name_b")), "block")
        .select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).where("name_a < name_b").distinct()
    )
    side = lambda s: known.select(F.col("name").alias(f"name_{s}"), F.struct("kind", "tokens", "initials", F.map_entries("w").alias("w")).alias(s))
    full = pairs.join(side("a"), "name_a").join(side("b"), "name_b")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(nicknames)
        for pdf in parts:
            rows = []
            for na, nb, a, b in zip(pdf["name_a"], pdf["name_b"], pdf["a"], pdf["b"]):
                w = [{e["key"]: e["value"] for e in x["w"]} for x in (a, b)]
                one, two = [(x["kind"], list(x["tokens"]), list(x["initials"])) for x in (a, b)]
                score, brief = similarity(one, two, *w)
                if score >= THRESHOLD:
                    rows.append((na, nb, brief))
            yield pd.DataFrame(rows, columns=["name_a", "name_b", "brief"])

    return full.mapInPandas(verify, "name_a string, name_b string, brief string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, entity): the least name that each name is connected with; joins and checkpoints only.

    Each round takes the least entity of the neighbours and then that entity's own, so that rounds grow with the logarithm of the longest
    chain; it goes on until nothing moves.
    """
    both = cut(edges.select(F.col("name_a").alias("x"), F.col("name_b").alias("y")).unionByName(edges.select(F.col("name_b").alias("x"), F.col("name_a").alias("y"))))
    at = cut(nodes.select("name", F.col("name").alias("entity")))
    while True:
        heard = both.join(at, both["y"] == at["name"]).groupBy("x").agg(F.min("entity").alias("least"))
        near = at.join(heard, at["name"] == heard["x"], "left").select("name", F.col("entity").alias("was"), F.least("entity", F.coalesce("least", "entity")).alias("entity"))
        hop = at.select(F.col("name").alias("entity"), F.col("entity").alias("root"))
        new = cut(near.join(hop, "entity").select("name", F.col("root").alias("entity"), (F.col("root") < F.col("was")).alias("moved")))
        at = new.select("name", "entity")
        if new.where("moved").isEmpty():
            return at


def entities(names: DataFrame, nicknames: bool = True) -> DataFrame:
    """(name, entity) of distinct non-blank names.

    Full names that are alike join at once. A spelling with initials only (or a login) joins an entity when exactly one fits;
    when several fit, it stands alone. Such spellings that fit none join each other if alike.
    """
    found = cut(links(names, nicknames))
    strong, weak = found.where("brief = ''"), found.where("brief <> ''")
    base = components(names, strong)
    side = lambda x, y: weak.select(F.col(f"name_{x}").alias("name"), F.col(f"name_{y}").alias("to"), F.col("brief").contains(x).alias("brief"), F.col("brief").contains(y).alias("to_brief"))
    ends = side("a", "b").unionByName(side("b", "a"))
    kind = ends.groupBy("name").agg(F.bool_or("brief").alias("brief"))
    reach = cut(
        ends.where("brief AND NOT to_brief").join(base.select(F.col("name").alias("to"), "entity"), "to")
        .groupBy("name").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity"))
    )
    lone = cut(kind.where("brief").join(reach, "name", "left_anti").select("name"))
    inside = lambda e: e.join(lone.select(F.col("name").alias("name_a")), "name_a", "left_semi").join(lone.select(F.col("name").alias("name_b")), "name_b", "left_semi")
    alone = components(lone, inside(found))
    return (
        base.join(reach.where("n = 1").select("name", F.col("entity").alias("near")), "name", "left")
        .join(alone.select("name", F.col("entity").alias("own")), "name", "left")
        .select("name", F.coalesce("near", "own", "entity").alias("entity"))
    )


def members(ownership: DataFrame, file_metrics: DataFrame, nicknames: bool = True) -> DataFrame:
    """(name, entity): every spelling, as stored, with the least spelling of its entity; the whole result in one row a name.

    Null and blank names are no names. Repeats count once. Names that differ only in white space or case are variants.
    ``nicknames`` off leaves the list of pet names out.
    """
    names = cut(
        ownership.select(F.col("author").alias("name")).unionByName(file_metrics.select(F.col("main_author").alias("name")))
        .where("name IS NOT NULL AND trim(name) <> ''").distinct()
    )
    return entities(names, nicknames)


def found(ownership: DataFrame, file_metrics: DataFrame) -> DataFrame:
    """p5_found: (name_a, name_b), all pairs of different spellings of one entity, as stored."""
    e = cut(members(ownership, file_metrics))
    return (
        e.select("entity", F.col("name").alias("name_a")).join(e.select("entity", F.col("name").alias("name_b")), "entity")
        .where("name_a < name_b").select("name_a", "name_b").distinct()
    )
