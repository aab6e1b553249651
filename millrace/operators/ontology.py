"""Classes of individuals by relational rules over triples ``(s, p, o)``, under a closed world."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.tree import closure


def of(triples: DataFrame, p: str) -> DataFrame:
    return triples.where(F.col("p") == p).select("s", "o")


def types(triples: DataFrame, subclass: DataFrame) -> DataFrame:
    """``s, o``: asserted types closed over ``subclass`` edges (``child`` below ``parent``)."""
    up = closure(subclass).select(F.col("node").alias("o"), F.col("anc").alias("t"))
    asserted = of(triples, "type")
    return asserted.join(up, "o", "left").select("s", F.coalesce("t", "o").alias("o")).union(asserted).distinct()


def has_value(triples: DataFrame, p: str, value: str) -> DataFrame:
    return of(triples, p).where(F.col("o") == value).select("s").distinct()


def some_from(triples: DataFrame, p: str, members: DataFrame) -> DataFrame:
    """Subjects with a value among ``members``."""
    return of(triples, p).join(members.select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct()


def some_at_least(triples: DataFrame, p: str, low: float) -> DataFrame:
    """Subjects with any value of at least ``low``; several values need only one."""
    return of(triples, p).where(F.expr("try_cast(o as decimal(18,6))") >= F.lit(low)).select("s").distinct()


def all_from(members: DataFrame, triples: DataFrame, p: str, allowed: list[str]) -> DataFrame:
    """Members with no value outside ``allowed``; those without any value are in."""
    return members.join(of(triples, p).where(~F.col("o").isin(*allowed)).select("s"), "s", "left_anti")


def both(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "s", "left_semi")
    return out


def but_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "s", "left_anti")


def inverse(triples: DataFrame, p: str, q: str) -> DataFrame:
    """``q`` as the inverse of ``p``, asserted either way."""
    return of(triples, q).union(of(triples, p).select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()


def sub_property(triples: DataFrame, p: str, subs: list[str]) -> DataFrame:
    return triples.where(F.col("p").isin(p, *subs)).select("s", "o").distinct()


def transitive(triples: DataFrame, p: str) -> DataFrame:
    """``s, o`` closed over ``p``, for relations in which each subject has one direct value."""
    e = of(triples, p)
    return closure(e.select(F.col("o").alias("parent"), F.col("s").alias("child"))).where("steps > 0").select(F.col("node").alias("s"), F.col("anc").alias("o"))


def functional_violations(triples: DataFrame, properties: list[str]) -> DataFrame:
    """Subjects and properties with more than one value where one is allowed."""
    return triples.where(F.col("p").isin(*properties)).groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n > 1")


def inferred_by_domain(triples: DataFrame, domain: dict[str, str], range_: dict[str, str]) -> DataFrame:
    """``s, o``: types that the use of a property implies for its subject and its object."""
    d = F.create_map(*[F.lit(x) for kv in domain.items() for x in kv])
    r = F.create_map(*[F.lit(x) for kv in range_.items() for x in kv])
    a = triples.select("s", F.try_element_at(d, F.col("p")).alias("o"))
    b = triples.select(F.col("o").alias("s"), F.try_element_at(r, F.col("p")).alias("o"))
    return a.union(b).where("o is not null").distinct()


#: An expression over classes, as nested tuples: ("class", name), ("and", e, ...), ("or", e, ...), ("not", e), ("value", p, v),
#: ("some", p, e), ("least", p, number), ("only", p, e), ("one_of", name, ...).
Expression = tuple


def members(e: Expression, triples: DataFrame, subclass: DataFrame, axioms: dict[str, Expression] | None = None, seen: frozenset[str] = frozenset()) -> DataFrame:
    """``s``: the distinct individuals of an expression under a closed world.

    A class holds those typed so, over ``subclass``, and those of its definition among
    ``axioms``. A complement is taken of all subjects, or of what an intersection's other
    parts leave; a class that is defined by itself is an error.
    """
    axioms = axioms or {}
    deeper = lambda x: members(x, triples, subclass, axioms, seen)
    everyone = lambda: triples.select("s").distinct()
    kind, *parts = e
    if kind == "class":
        name = parts[0]
        if name in seen:
            raise ValueError(f"{name} is defined by itself")
        typed = types(triples, subclass).where(F.col("o") == name).select("s")
        if name in axioms:
            typed = typed.union(members(axioms[name], triples, subclass, axioms, seen | {name}))
        return typed.distinct()
    if kind == "and":
        # what only takes away comes last, from what the others leave
        taken = [p for p in parts if p[0] in ("not", "only")]
        given = [deeper(p) for p in parts if p not in taken]
        out = both(*given) if given else everyone()
        for p in taken:
            out = but_not(out, deeper(p[1])) if p[0] == "not" else _only(out, triples, p[1], deeper(p[2]))
        return out.distinct()
    if kind == "or":
        return reduce(DataFrame.union, map(deeper, parts)).distinct()
    if kind == "not":
        return but_not(everyone(), deeper(parts[0]))
    if kind == "only":
        return _only(everyone(), triples, parts[0], deeper(parts[1]))
    if kind == "value":
        return has_value(triples, *parts)
    if kind == "some":
        return some_from(triples, parts[0], deeper(parts[1]))
    if kind == "least":
        return some_at_least(triples, parts[0], parts[1])
    if kind == "one_of":
        return triples.sparkSession.createDataFrame([(n,) for n in parts], "s string")
    raise ValueError(f"no expression {kind!r}")


def _only(these: DataFrame, triples: DataFrame, p: str, allowed: DataFrame) -> DataFrame:
    """Those of ``these`` with no value of ``p`` outside ``allowed``; those without any value are in."""
    other = of(triples, p).join(allowed.select(F.col("s").alias("o")), "o", "left_anti").select("s")
    return but_not(these, other)
