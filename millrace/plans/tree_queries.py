"""Trees over ``part`` and class rules over literal triples and the nation tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import ontology as O
from millrace.operators import tree as T

#: Individuals of the sports ontology, as (subject, property, object).
TRIPLES = [
    tuple(line.split("|"))
    for line in """
GiannisAntetokounmpo|type|Player
GiannisAntetokounmpo|playsFor|MilwaukeeBucks
GiannisAntetokounmpo|hasPosition|PowerForward
GiannisAntetokounmpo|hasWon|NBAChampionship
GiannisAntetokounmpo|age|30
GiannisAntetokounmpo|assists|6.2
GiannisAntetokounmpo|points|30.1
GiannisAntetokounmpo|rebounds|11.5
GiannisAntetokounmpo|threePoint|0.30
JaysonTatum|type|Player
JaysonTatum|playsFor|BostonCeltics
JaysonTatum|hasPosition|SmallForward
JaysonTatum|age|26
JaysonTatum|assists|4.9
JaysonTatum|points|27.2
JaysonTatum|rebounds|8.1
JaysonTatum|threePoint|0.38
LebronJames|type|Player
LebronJames|playsFor|LosAngelesLakers
LebronJames|hasPosition|SmallForward
LebronJames|hasWon|NBAChampionship
LebronJames|age|39
LebronJames|assists|7.4
LebronJames|points|25.3
LebronJames|points|7.2
LebronJames|threePoint|0.35
NikolaJokic|type|Player
NikolaJokic|playsFor|DenverNuggets
NikolaJokic|hasPosition|Center
NikolaJokic|hasWonAward|MVP_Award
NikolaJokic|hasWon|NBAChampionship
NikolaJokic|age|29
NikolaJokic|assists|10.2
NikolaJokic|points|26.4
NikolaJokic|rebounds|12.1
NikolaJokic|threePoint|0.36
StephenCurry|type|Player
StephenCurry|playsFor|GoldenStateWarriors
StephenCurry|hasPosition|PointGuard
StephenCurry|hasWon|NBAChampionship
StephenCurry|age|35
StephenCurry|points|29.4
StephenCurry|threePoint|0.42
SteveKerr|type|Coach
SteveKerr|coaches|GoldenStateWarriors
SteveKerr|hasWon|NBAChampionship
BostonCeltics|type|NBATeam
BostonCeltics|inConference|Eastern
BostonCeltics|inDivision|Atlantic
ClevelandCavaliers|type|NBATeam
ClevelandCavaliers|inConference|Eastern
ClevelandCavaliers|inDivision|Central
MilwaukeeBucks|type|NBATeam
MilwaukeeBucks|inConference|Eastern
MilwaukeeBucks|inDivision|Central
DenverNuggets|type|NBATeam
DenverNuggets|inConference|Western
DenverNuggets|inDivision|Northwest
GoldenStateWarriors|type|NBATeam
GoldenStateWarriors|inConference|Western
GoldenStateWarriors|inDivision|Pacific
LosAngelesLakers|type|NBATeam
LosAngelesLakers|inConference|Western
LosAngelesLakers|inDivision|Pacific
NBAChampionship|type|Championship
MVP_Award|type|Award
""".split()
]
#: Individuals of our own, on both sides of every rule.
TRIPLES += [
    tuple(line.split("|"))
    for line in """
HarborHerons|type|NBATeam
HarborHerons|inDivision|Atlantic
HarborHerons|winPercentage|0.75
LakesideLynx|type|NBATeam
LakesideLynx|winPercentage|0.60
MesaMules|type|NBATeam
MesaMules|winPercentage|0.599
OldNoRing|type|Player
OldNoRing|playsFor|HarborHerons
OldNoRing|age|32
OldNoRing|hasPosition|PointGuard
OldNoRing|hasPosition|ShootingGuard
OldWithRing|type|Player
OldWithRing|playsFor|HarborHerons
OldWithRing|age|36
OldWithRing|hasWonAward|NBAChampionship
YoungNoRing|type|Player
YoungNoRing|playsFor|LakesideLynx
YoungNoRing|age|31.9
YoungNoRing|assists|10
YoungNoRing|points|10.0
YoungNoRing|rebounds|12
OldElsewhere|type|Player
OldElsewhere|playsFor|MesaMules
OldElsewhere|age|40
OldElsewhere|age|41
OldElsewhere|threePoint|0.4
""".split()
]
#: Subclass edges, (class, superclass).
SUBCLASSES = [("Player", "BasketballProfessional"), ("Coach", "BasketballProfessional"), ("BasketballProfessional", "Person"), ("NBATeam", "Team"), ("Team", "Organization")]
DOMAINS = {"playsFor": "Player", "coaches": "Coach", "inDivision": "NBATeam"}
RANGES = {"playsFor": "NBATeam", "coaches": "NBATeam", "inDivision": "Division"}


def triples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRIPLES, "s string, p string, o string")


def subclasses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBCLASSES, "child string, parent string")


def part_tree(spark: SparkSession, d: str) -> DataFrame:
    """The implicit heap over part keys: every key above 0 hangs on half of the key before it."""
    return table(spark, d, "part").where("p_partkey > 0").select(F.floor((F.col("p_partkey") - 1) / 2).cast("long").alias("parent"), F.col("p_partkey").alias("child"))


def tree_facts(spark: SparkSession, d: str) -> DataFrame:
    """Depth, height and subtree size of every node."""
    return T.node_facts(part_tree(spark, d))


def tree_depths(spark: SparkSession, d: str) -> DataFrame:
    return T.lifting_table(part_tree(spark, d))[0]


def level_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of every node at three depths, one of them too deep for most."""
    q = table(spark, d, "part").select(F.col("p_partkey").alias("u"), F.explode(F.array(F.lit(0), F.lit(4), F.lit(9))).alias("d"))
    return T.level_ancestor(q, part_tree(spark, d))


def lca(spark: SparkSession, d: str) -> DataFrame:
    """Lowest common ancestor of every node and the node of seven times its key, within the tree."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("u"))
    n = p.agg(F.max("u")).scalar()
    return T.lowest_common_ancestor(p.select("u", ((F.col("u") * 7 + 3) % (n + 1)).alias("v")), part_tree(spark, d))


def tree_print(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the tree, each node indented by its depth and followed by its subtree; ``place`` is the line's number."""
    return T.preorder(part_tree(spark, d)).select("place", "node", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node").cast("string")).alias("line"))


def place_containment(spark: SparkSession, d: str) -> DataFrame:
    """Containment of customers in nations and regions, closed."""
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    nation = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    person = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent"))
    located = nation.union(person).select(F.col("child").alias("s"), F.lit("locatedIn").alias("p"), F.col("parent").alias("o"))
    return O.transitive(located, "locatedIn")


#: Definitions of classes, as ``readers.read_axioms`` reads them from a document.
AXIOMS = {
    "celtics_player": ("and", ("class", "Player"), ("value", "playsFor", "BostonCeltics")),
    "atlantic_team": ("and", ("class", "NBATeam"), ("value", "inDivision", "Atlantic")),
    "champion": ("and", ("class", "Player"), ("some", "hasWon", ("class", "Championship"))),
    "champion_coach": ("and", ("class", "Coach"), ("some", "hasWon", ("class", "Championship"))),
    "contender_team": ("and", ("class", "NBATeam"), ("least", "winPercentage", 0.60)),
    "elite_shooter": ("and", ("class", "Player"), ("least", "threePoint", 0.40)),
    "veteran_player": ("and", ("class", "Player"), ("least", "age", 32)),
    "triple_double": ("and", ("class", "Player"), ("least", "assists", 10), ("least", "points", 10), ("least", "rebounds", 10)),
    "pure_guard": ("and", ("class", "Player"), ("only", "hasPosition", ("one_of", "PointGuard", "ShootingGuard"))),
    "veteran_ring_chaser": ("and", ("class", "veteran_player"), ("not", ("class", "champion")), ("some", "playsFor", ("class", "contender_team"))),
}


def _classes(t: DataFrame, sub: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    # a value of a sub-property is one of the property
    closed = t.unionByName(O.sub_property(t, "hasWon", ["hasWonAward"]).select("s", F.lit("hasWon").alias("p"), "o")).distinct()
    return {name: partial(O.members, ("class", name), closed, sub, AXIOMS) for name in AXIOMS}


def _owl(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _classes(triples(spark), subclasses(spark))[name]().distinct()

    query.__doc__ = f"Members of the class {name}."
    return query


def owl_types(spark: SparkSession, d: str) -> DataFrame:
    return O.types(triples(spark), subclasses(spark))


def owl_inverse(spark: SparkSession, d: str) -> DataFrame:
    return O.inverse(triples(spark), "playsFor", "hasRosterPlayer")


def owl_subproperty(spark: SparkSession, d: str) -> DataFrame:
    return O.sub_property(triples(spark), "hasWon", ["hasWonAward"])


def owl_functional_violations(spark: SparkSession, d: str) -> DataFrame:
    return O.functional_violations(triples(spark), ["age", "winPercentage", "points"])


def owl_domain_types(spark: SparkSession, d: str) -> DataFrame:
    return O.inferred_by_domain(triples(spark), DOMAINS, RANGES)


QUERIES = {f.__name__: f for f in (tree_facts, tree_depths, level_ancestor, lca, tree_print, place_containment, owl_types, owl_inverse, owl_subproperty, owl_functional_violations, owl_domain_types)} | {
    f"owl_{n}": _owl(n) for n in AXIOMS
}

_T = "t(s, p, o) as (values " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in TRIPLES) + ")"
_SUB = "sub(c, b) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in SUBCLASSES) + ")"
_TYPES = f"{_T}, {_SUB}, ty as (select s, o from t where p = 'type' union select ty.s, sub.b from ty join sub on sub.c = ty.o)"
_IS = "s in (select s from ty where o = '{}')"
_MIN = "s in (select s from t where p = '{}' and try_cast(o as decimal(18,6)) >= {})"
_CHAMP = "s in (select s from t where p in ('hasWon', 'hasWonAward') and o in (select s from ty where o = 'Championship'))"
_WHERE = {
    "celtics_player": f"{_IS.format('Player')} and s in (select s from t where p = 'playsFor' and o = 'BostonCeltics')",
    "atlantic_team": f"{_IS.format('NBATeam')} and s in (select s from t where p = 'inDivision' and o = 'Atlantic')",
    "champion": f"{_IS.format('Player')} and {_CHAMP}",
    "champion_coach": f"{_IS.format('Coach')} and {_CHAMP}",
    "contender_team": f"{_IS.format('NBATeam')} and {_MIN.format('winPercentage', 0.6)}",
    "elite_shooter": f"{_IS.format('Player')} and {_MIN.format('threePoint', 0.4)}",
    "veteran_player": f"{_IS.format('Player')} and {_MIN.format('age', 32)}",
    "triple_double": f"{_IS.format('Player')} and " + " and ".join(_MIN.format(p, 10) for p in ("assists", "points", "rebounds")),
    "pure_guard": f"{_IS.format('Player')} and s not in (select s from t where p = 'hasPosition' and o not in ('PointGuard', 'ShootingGuard'))",
    "veteran_ring_chaser": f"{_IS.format('Player')} and {_MIN.format('age', 32)} and not ({_CHAMP}) and s in (select s from t where p = 'playsFor' and o in (select s from t where p = 'winPercentage' and try_cast(o as decimal(18,6)) >= 0.6))",
}
_E = "e as (select (p_partkey - 1) // 2 as parent, p_partkey as child from part where p_partkey > 0), n as (select parent as node from e union select child from e)"
_CLO = f"{_E}, clo as (select node, node as anc, 0 as steps from n union all select clo.node, e.parent, steps + 1 from clo join e on e.child = clo.anc), dep as (select node, max(steps) as depth from clo group by 1)"

SQL = {
    "tree_facts": f"with recursive {_CLO} select node, depth, height, size from dep join (select anc as node, max(steps) + 1 as height, count(*) as size from clo group by 1) using (node)",
    "tree_depths": f"with recursive {_CLO} select node, depth from dep",
    "tree_print": f"with recursive {_E}, pa as (select node, [node] as path from n where node not in (select child from e) union all select e.child, list_append(path, e.child) from pa join e on e.parent = pa.node) select row_number() over (order by path) - 1 as place, node, repeat('  ', len(path) - 1) || node as line from pa",
    "level_ancestor": f"""with recursive {_CLO}, q as (select p_partkey as u, unnest([0, 4, 9]) as d from part)
        select u, d, coalesce(anc, -1) as ancestor from q left join dep on dep.node = u left join clo on clo.node = u and clo.steps = depth - d and d >= 0""",
    "lca": f"""with recursive {_CLO}, q as (select p_partkey as u, (p_partkey * 7 + 3) % ((select max(p_partkey) from part) + 1) as v from part)
        select u, v, arg_max(a.anc, dep.depth) as lca from q join clo a on a.node = u join clo b on b.node = v and a.anc = b.anc join dep on dep.node = a.anc group by 1, 2""",
    "place_containment": """select n_name as s, r_name as o from nation join region on n_regionkey = r_regionkey union all select c_name, n_name from customer join nation on c_nationkey = n_nationkey
        union all select c_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "owl_types": f"with recursive {_TYPES} select distinct s, o from ty",
    "owl_inverse": f"with {_T} select distinct o as s, s as o from t where p = 'playsFor'",
    "owl_subproperty": f"with {_T} select distinct s, o from t where p in ('hasWon', 'hasWonAward')",
    "owl_functional_violations": f"with {_T} select s, p, count(distinct o) as n from t where p in ('age', 'winPercentage', 'points') group by 1, 2 having count(distinct o) > 1",
    "owl_domain_types": f"with {_T} select distinct * from (select s, case p " + " ".join(f"when '{k}' then '{v}'" for k, v in DOMAINS.items()) + " end as o from t union all select o, case p " + " ".join(f"when '{k}' then '{v}'" for k, v in RANGES.items()) + " end from t) where o is not null",
} | {f"owl_{n}": f"with recursive {_TYPES} select distinct s from t where {w}" for n, w in _WHERE.items()}
