"""Variant spellings of persons and houses: canonical rewritings, exploded and equi-joined.

Every distinct spelling is parsed into a family or house name, given names and initials.
Rules rewrite it: nicknames to the given names they stand for, given names to initials, legal
forms and abbreviations of kinds of house to one word, tokens to one order, and misspelt
names to the spellings they share with their neighbours (the name with up to two letters left
out, or for long names its fifths at nearby places, of which two edits leave one whole).
Spellings that are read alike have the same rewritings and go through as one. The rewritings
are exploded and equi-joined, those of a single reading left out; each pair that shares one is
scored by the rarity of its rarest shared rewriting - 1 where nobody else has it - and judged
on the whole names.

Which of two names without a comma is the family is told by rarity: a given name goes with
many others, a family name with few. A spelling that only has initials, or leaves out a middle
initial, is linked to the one person it fits, or to the one whose family name is fewest edits
away, or of those to the one that its rewritings single out clearly by their rarity; and to
nobody if it fits several alike. Links between spellings with a given name are closed to whole
persons by connected components; each spelling with initials only then finds its person by
itself, as in a large table those of two persons are often alike, and only those that found
none are linked to each other. A lone family name is linked to other lone ones only, as any of
its bearers may be meant.

Rows are reduced to distinct spellings first, so a spelling on a third of all rows is one row
here. Nulls, blanks, and filler words mean nobody and have no variants. All joins of data to
data are merge joins, which spill and which adaptive execution splits at hot rewritings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.value_mapping import edit_distance
from millrace.session import durable

#: Words that name nobody.
FILLERS = frozenset("unknown n/a na none null nan anonymous anon various not available author unknown no author - -- ? ??? . tba tbd not applicable unspecified misc n.a. x".split()) | {
    "not available", "unknown author", "no author", "author unknown", "not applicable", "various authors", "unknown publisher", "no publisher", "self published",
}
#: Titles and marks around a person's name.
TITLES = frozenset("dr prof professor doctor phd md mr mrs ms miss sir dame jr sr author editor translator dphil msc ba ma".split())
#: Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy al xander", "alexandra": "alex sasha sandra", "anastasia": "nastya stacy ana", "andrew": "andy drew", "anthony": "tony",
    "beatrix": "bea trixie trix", "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christine": "chris chrissy tina", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave", "deborah": "debbie deb debby", "dmitri": "dima mitya", "donald": "don", "dorothy": "dot dolly",
    "edward": "ed eddie ted ned teddy", "ekaterina": "katya kate katia", "elizabeth": "liz beth betty eliza lizzie bess lisa", "frederick": "fred freddie freddy",
    "georgi": "gosho george", "gregory": "greg", "helena": "helen lena", "ingrid": "inga", "ivan": "vanya", "james": "jim jimmy jamie", "jennifer": "jenny jen",
    "john": "jack johnny", "joseph": "joe joey", "katherine": "kate kathy katie kath kitty", "kenneth": "ken", "leon": "leo", "margaret": "meg peggy maggie marge daisy rita",
    "martina": "tina", "mary": "molly polly", "matthew": "matt", "michael": "mike mick micky", "nicholas": "nick nicky", "patricia": "pat trish patty tricia",
    "patrick": "pat paddy", "peter": "pete", "rebecca": "becky", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert", "rosa": "rosie",
    "samuel": "sam sammy", "steven": "steve", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "ulrich": "uli", "victoria": "vicky vicki tori",
    "vladimir": "volodya vova vlad", "walter": "walt", "william": "bill will billy willie liam",
}
MEANS: dict[str, frozenset[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in (_name, *_short.split()):
        MEANS[_s] = MEANS.get(_s, frozenset()) | {_name}
#: Legal forms and words that tell nothing of a house.
LEGAL = frozenset("the inc incorporated ltd limited llc co company corp corporation gmbh ag plc sa srl bv paperbacks paperback hardcover and".split())
#: Kinds of house and their abbreviations.
KINDS = {
    "press": "pr", "verlag": "verl vlg", "books": "bks book bk", "editions": "eds ed edns edn edition", "publish": "publishing publishers publisher publ pub pubs publrs publg", "house": "hs hse",
    "university": "univ uni", "sons": "son", "brothers": "bros", "group": "grp", "media": "", "academic": "acad",
}
KIND_OF = {w: k for k, v in KINDS.items() for w in (k, *v.split())}


#: Other names that a given name goes with at least, for rarity to tell it from a family; else both readings are tried.
#: Two given names of that kind are names of their own and no misspellings of each other, unless one goes with so many
#: times as many others as the other: a large table has the same misspelling of a common name with many families.
GIVEN_PARTNERS, COMMONER = 15, 10


def plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s).casefold()
    return "".join(c for c in s if not unicodedata.combining(c))


def parse_person(raw: str) -> tuple[str, list[str], list[str]] | None:
    """(family or '', long names, initials) of a person; the family is known where a comma or a lone name tells it."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", plain(raw))
    if " ".join(s.split()) in FILLERS:
        return None
    s = re.sub(r"\b(?:ph\.?\s?d|m\.a|b\.a|m\.d|m\.sc|d\.phil)\.?\s*$", " ", s)  # initials of a name have a space between
    parts = [[w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", p) if w not in TITLES] for p in s.split(",")]
    parts = [p for p in parts if p]
    words = [w for p in parts for w in p]
    long, initials = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    if not long:
        return None
    family = ""
    if len(parts) > 1 and (first := [w for w in parts[0] if len(w) > 1]) and len(first) < len(words):
        family = " ".join(first) if len(first) == 1 or any(w for p in parts[1:] for w in p) else ""
    elif len(long) == 1:
        family = long[0]
    else:
        known = [w for w in long if w in MEANS]
        if len(known) == len(long) - 1:
            family = next(w for w in long if w not in MEANS)
    return family, long, initials


def parse_house(raw: str) -> tuple[str, list[str]] | None:
    """(own name, kinds) of a publishing house."""
    s = re.sub(r"\([^)]*\)", " ", plain(raw))
    if " ".join(s.split()) in FILLERS:
        return None
    s = re.sub(r"\bu\.?\s?p\b\.?", " university press ", s)
    words = [w for w in re.findall(r"[^\W_]+", s) if w not in LEGAL]
    kinds = sorted({KIND_OF[w] for w in words if w in KIND_OF})
    own = [w for w in words if w not in KIND_OF]
    if not own:
        own, kinds = [w for w in words if w in KIND_OF], []
    return (" ".join(own), kinds) if own else None


def reach_of(n: int) -> int:
    """Edits within which names of n letters, the shorter's, may be one."""
    return 2 if n >= 8 else 1 if n >= 5 else 0


#: Letters up to which letters are left out; longer names are cut in so many parts, as a swap at a cut may break two.
SHORT, PARTS = 20, 5


def shortened(name: str, depth: int) -> set[str]:
    """The name with up to ``depth`` letters left out."""
    n = len(name)
    return {"".join(c for i, c in enumerate(name) if i not in gone) for d in range(min(depth, n) + 1) for gone in combinations(range(n), d)}


def parts_of(name: str, reach: int) -> set[str]:
    """Parts of the name, each marked by its number and by the length of a name that it may be a part of.

    A name of length m is cut in ``PARTS`` parts; in a name within ``reach`` edits one of them
    stands whole, at most ``reach`` places away. All lengths and places in reach are given.
    """
    out = set()
    for m in range(max(PARTS, len(name) - reach), len(name) + reach + 1):
        cuts = [m * k // PARTS for k in range(PARTS + 1)]
        for k in range(PARTS):
            width = cuts[k + 1] - cuts[k]
            for at in range(max(0, cuts[k] - reach), min(len(name) - width, cuts[k] + reach) + 1):
                out.add(f"{m}.{k}.{name[at : at + width]}")
    return out


def misspelt(name: str, most: int = 2) -> set[str]:
    """Rewritings of which two names within :func:`reach_of` edits, or ``most``, share one."""
    n, depth = len(name), min(most, reach_of(len(name)))
    out = {name}
    if n <= SHORT:
        out |= shortened(name, depth)
    if n > SHORT - 2:
        out |= parts_of(name, depth)
    return out


def _first_letters(given: str, initials: list[str]) -> set[str]:
    if given:
        return {given[0]} | {m[0] for m in MEANS.get(given, ())}
    return {initials[0]} if initials else {""}


def _given_distance(a: str, b: str) -> int:
    if a == b or MEANS.get(a, frozenset((a,))) & MEANS.get(b, frozenset((b,))):
        return 0
    forms_a, forms_b = {a} | MEANS.get(a, frozenset()), {b} | MEANS.get(b, frozenset())
    return min(edit_distance(x, y) for x in forms_a for y in forms_b)


def link_kind(a: dict, b: dict) -> int:
    """3: the same person as far as told by both; 2: one leaves out a middle initial or a kind; 1: one has initials only; 0: not the same."""
    fa, fb = a["family"], b["family"]
    reach = reach_of(min(len(fa), len(fb)))
    d = edit_distance(fa, fb) if abs(len(fa) - len(fb)) <= reach else 9
    if d > reach:
        return 0
    if a["field"] == "publisher":
        ka, kb = set(a["kinds"]), set(b["kinds"])
        return 3 if ka == kb else 2 if (ka < kb or kb < ka) and d <= 1 else 0
    ia, ib = list(a["initials"]), list(b["initials"])
    ga, gb = a["given"], b["given"]
    if ga and gb:
        g = _given_distance(ga, gb)
        if g > (2 if d == 0 and min(len(ga), len(gb)) >= 5 else 1 if d <= 1 and min(len(ga), len(gb)) >= 3 else 0):
            return 0
        na, nb = a["partners"], b["partners"]
        if g and all(x in MEANS or n >= max(GIVEN_PARTNERS, other / COMMONER) for x, n, other in ((ga, na, nb), (gb, nb, na))):
            return 0
        return 0 if ia and ib and ia[0] != ib[0] else 3 if bool(ia) == bool(ib) else 2
    if not ga and not gb:
        if not ia or not ib:
            return 0 if ia or ib else 3
        if ia[0] != ib[0]:
            return 0
        return 0 if len(ia) > 1 and len(ib) > 1 and ia[1] != ib[1] else 3 if len(ia) == len(ib) else 2
    (g, i, j) = (ga, ia, ib) if ga else (gb, ib, ia)
    if not j or j[0] not in _first_letters(g, []):
        return 0
    return 0 if len(j) > 1 and i and i[0] != j[1] else 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, field, name in zip(b["id"], b["field"], b["name"], strict=True):
            if field == "publisher":
                if p := parse_house(name):
                    rows.append((i, field, name, p[0], [], [], p[1]))
            elif p := parse_person(name):
                rows.append((i, field, name, p[0], p[1], p[2], []))
        yield pd.DataFrame(rows, columns=["id", "field", "name", "family", "long", "initials", "kinds"])


def rewritings(field: str, family: str, given: str, initials: list[str]) -> set[str]:
    """Every canonical form of a reading.

    House: misspellings of its own name. Person: first letter and misspellings of the family;
    for a misspelt first letter the last one and misspellings of the family by one edit, as
    two names are not both judged by two; the family and misspellings of the given name and of
    those it stands for.
    """
    if field == "publisher":
        return {f"h|{s}" for s in misspelt(family)}
    families = misspelt(family)
    out = {f"i|{x}|{s}" for s in families for x in _first_letters(given, initials)}
    if given:
        out |= {f"l|{given[-1]}|{s}" for s in misspelt(family, 1)} if len(given) > 2 else set()
        out |= {f"g|{family}|{s}" for g in {given} | MEANS.get(given, frozenset()) for s in (misspelt(g) | (shortened(g, 2) if 5 <= len(g) < 8 else set()))}
    return out


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [
            (i, f"{field}|{form}")
            for i, field, family, given, initials in zip(b["id"], b["field"], b["family"], b["given"], b["initials"], strict=True)
            for form in rewritings(field, family, given or "", list(initials))
        ]
        yield pd.DataFrame(rows, columns=["id", "form"])


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for x, y, score in zip(b["x"], b["y"], b["score"], strict=True):
            if k := link_kind(x, y):
                rows.append((x["id"], y["id"], k, -edit_distance(x["family"], y["family"]), score, bool(x["given"]) or x["field"] == "publisher", bool(y["given"]) or y["field"] == "publisher", len(x["initials"]) + len(x["kinds"]), len(y["initials"]) + len(y["kinds"])))
        yield pd.DataFrame(rows, columns=["a", "b", "kind", "near", "score", "full_a", "full_b", "more_a", "more_b"])


def spellings(df: DataFrame, fields: list[str]) -> DataFrame:
    """``id, field, name`` of the distinct non-blank spellings, numbered as they lie in the written table."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("name")) for f in fields])
    d = durable(df.select(F.explode(parts).alias("p")).select("p.field", "p.name").where("name is not null and trim(name) <> ''").distinct())
    return d.select(F.monotonically_increasing_id().alias("id"), "field", "name")


#: Names that one task parses and rewrites, and pairs that one task judges.
NAMES_A_TASK, PAIRS_A_TASK = 5_000, 50_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is written already, in tasks of so many rows, as what Python makes of them is not told by their bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1))


def entries(names: DataFrame) -> DataFrame:
    """Parsed spellings with the family told from the given name; both ways where rarity cannot tell."""
    parsed = spread(names, NAMES_A_TASK).mapInPandas(_parse, "id long, field string, name string, family string, long array<string>, initials array<string>, kinds array<string>")
    token = parsed.where("size(long) > 1").select("id", F.explode("long").alias("token"), "long")
    partners = token.select("token", F.explode(F.array_except("long", F.array("token"))).alias("other")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("partners"))
    open_ = parsed.where("family = '' and size(long) > 1").select("id", F.explode("long").alias("token"))
    told = open_.hint("merge").join(partners.hint("merge"), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("partners", "token"))).alias("t"))
    rarest, common = F.col("t")[0], F.element_at("t", -1)
    families = F.when(F.col("t").isNull(), F.array(F.col("family"))).when(
        (common["partners"] >= F.lit(4) * rarest["partners"]) & (common["partners"] >= GIVEN_PARTNERS), F.array(rarest["token"])
    ).otherwise(F.transform("t", lambda s: s["token"]))
    roles = parsed.hint("merge").join(told.hint("merge"), "id", "left").select("id", "field", "name", "long", "initials", "kinds", F.explode(F.when(F.col("family") != "", F.array("family")).otherwise(families)).alias("family"))
    given = F.filter("long", lambda w: ~F.array_contains(F.split("family", " "), w))
    out = roles.select("id", "field", "family", F.coalesce(F.get(given, F.lit(0)), F.lit("")).alias("given"), "initials", "kinds").where("family <> ''")
    known = partners.select(F.col("token").alias("given"), "partners")
    return out.hint("merge").join(known.hint("merge"), "given", "left").select("id", "field", "family", "given", "initials", "kinds", F.coalesce("partners", F.lit(0)).alias("partners"))


def readings(entry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, head`` for every spelling, the smallest id that is read alike; and the entries of the heads."""
    one = F.struct("field", "family", "given", "initials", "kinds")
    alike = entry.groupBy("id").agg(F.md5(F.to_json(F.array_sort(F.collect_set(one)))).alias("_s"))
    heads = alike.groupBy("_s").agg(F.min("id").alias("head"))
    of = durable(alike.hint("merge").join(heads.hint("merge"), "_s").select("id", "head"))
    return of, durable(entry.hint("merge").join(of.where("id = head").select("id").hint("merge"), "id", "left_semi"))


def links(entry: DataFrame) -> DataFrame:
    """Judged pairs of readings that share a rewriting, each with the rarity of its rarest one."""
    forms = spread(entry, NAMES_A_TASK).mapInPandas(_rewrite, "id long, form string").distinct()
    counts = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(forms.hint("merge").join(counts.hint("merge"), "form"))
    pairs = durable(
        shared.select(F.col("id").alias("a"), "form", "n").hint("merge").join(shared.select(F.col("id").alias("b"), "form").hint("merge"), "form")
        .where("a < b").groupBy("a", "b").agg((F.lit(2.0) / F.min("n")).alias("score"))
    )
    side = entry.select("id", F.struct("id", "field", "family", "given", "initials", "kinds", "partners").alias("e"))
    x, y = side.select(F.col("id").alias("a"), F.col("e").alias("x")), side.select(F.col("id").alias("b"), F.col("e").alias("y"))
    judged = spread(pairs, PAIRS_A_TASK).hint("merge").join(x.hint("merge"), "a").hint("merge").join(y.hint("merge"), "b")
    out = judged.select("x", "y", "score").mapInPandas(_judge, "a long, b long, kind int, near int, score double, full_a boolean, full_b boolean, more_a int, more_b int")
    return out.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("kind", "near", "score", "full_a", "full_b", "more_a", "more_b")])


#: How many times the rarity of the next person's rewriting one's own must have to be singled out.
CLEARLY = 2.0


def _attach(members: DataFrame, weak: DataFrame) -> DataFrame:
    """Merge each component into the only one its weak links (``low`` to ``high``) lead to, or the nearest, or of those as near the one that rarity singles out; leave it else."""
    a = members.select(F.col("id").alias("low"), F.col("c").alias("low_c"))
    b = members.select(F.col("id").alias("high"), F.col("c").alias("high_c"))
    offers = weak.hint("merge").join(a.hint("merge"), "low").hint("merge").join(b.hint("merge"), "high").where("low_c <> high_c").groupBy("low_c", "high_c").agg(F.max(F.struct("near", "score")).alias("s"))
    best = offers.groupBy("low_c").agg(F.max(F.struct("s.near", "s.score", "high_c")).alias("t"))
    other = offers.hint("merge").join(best.hint("merge"), "low_c").where("high_c <> t.high_c and s.near = t.near").groupBy("low_c").agg(F.max("s.score").alias("next"))
    target = (
        best.hint("merge").join(other.hint("merge"), "low_c", "left").where(F.col("next").isNull() | (F.col("t.score") >= F.lit(CLEARLY) * F.col("next")))
        .select(F.col("low_c").alias("c"), F.col("t.high_c").alias("one"))
    )
    hop = target.select(F.col("c").alias("one"), F.col("one").alias("next"))
    target = target.hint("merge").join(hop.hint("merge"), "one", "left").where("next is null or next <> c or one < c").select("c", F.col("one"))
    return members.hint("merge").join(target.hint("merge"), "c", "left").select("id", F.coalesce("one", "c").alias("c"))


def variant_classes(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field_name, name, class, score``: every spelling that has variants, the smallest name of its class, and the rarity of its best link."""
    names = spellings(df, fields)
    of, entry = readings(durable(entries(names)))
    link = durable(links(entry))
    strong = components(link.where("kind = 3 and full_a and full_b"))
    heads = of.where("id = head").select("id")
    c = heads.hint("merge").join(strong.hint("merge"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c"))
    swap = link.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "near", "score", F.col("full_b").alias("full_a"), F.col("full_a").alias("full_b"), F.col("more_b").alias("more_a"), F.col("more_a").alias("more_b"))
    both = link.unionByName(swap)
    offer = lambda told: both.where(told).select(F.col("a").alias("low"), F.col("b").alias("high"), "near", "score")
    c = durable(_attach(c, offer("kind = 2 and full_a and full_b and more_a < more_b")))
    c = durable(_attach(c, offer("kind = 1 and not full_a and full_b")))
    # those without a given name that found no person: linked to each other, and to the persons of those they are alike to
    lone = entry.groupBy("id").agg(F.max(F.expr("given <> '' or field = 'publisher'")).alias("full")).where("not full").select("id")
    loose = durable(c.where("id = c").select("id").hint("merge").join(lone.hint("merge"), "id", "left_semi"))
    initials = "not full_a and not full_b"
    among = link.where(f"kind = 3 and {initials}").hint("merge").join(loose.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").hint("merge").join(loose.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi")
    groups = components(among)
    c = c.hint("merge").join(groups.hint("merge"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "c").alias("c"))
    led = offer(f"(kind = 3 or kind = 2 and more_a < more_b) and {initials}").hint("merge").join(loose.select(F.col("id").alias("low")).hint("merge"), "low", "left_semi")
    c = durable(_attach(c, led))
    alike = of.groupBy("head").agg(F.count(F.lit(1)).alias("_n"))
    scores = both.groupBy(F.col("a").alias("head")).agg(F.max("score").alias("_s"))
    members = of.hint("merge").join(c.select(F.col("id").alias("head"), "c").hint("merge"), "head").hint("merge").join(alike.hint("merge"), "head").hint("merge").join(scores.hint("merge"), "head", "left")
    named = members.select("id", "c", F.when(F.col("_n") > 1, F.lit(1.0)).otherwise(F.col("_s")).alias("score")).hint("merge").join(names.hint("merge"), "id")
    sizes = named.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("class")).where("n > 1").select("c", "class")
    return named.hint("merge").join(sizes.hint("merge"), "c").select(F.col("field").alias("field_name"), "name", "class", "score")


def variant_pairs(classes: DataFrame) -> DataFrame:
    """``field_name, name_a, name_b`` for every two spellings of a class."""
    x = classes.select("field_name", "class", F.col("name").alias("name_a"))
    y = classes.select("field_name", "class", F.col("name").alias("name_b"))
    return x.hint("merge").join(y.hint("merge"), ["field_name", "class"]).where("name_a < name_b").select("field_name", "name_a", "name_b").distinct()
