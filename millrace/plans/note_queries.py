"""Queries of the methods that are only described: tags, trust, attacks, mixtures, weights of terms, sampling, learners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.operators import collaborative as C
from millrace.operators import language_model, models, social, text
from millrace.operators.relational import order_hash_sql
from millrace.plans.measure_queries import _ratings


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Line items as whole marks from 0 to 5 that customers give to parts."""
    return _ratings(spark, d).select(F.col("user_id").alias("u"), F.col("item").alias("i"), F.floor(F.col("rating") / 2).cast("double").alias("r"))


def _r(spark: SparkSession, d: str) -> DataFrame:
    return C.one_rating(_ratings(spark, d), "user_id", "item")


def tag_scores(spark: SparkSession, d: str) -> DataFrame:
    """Marks of parts foretold from the brands and types that a customer marks."""
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.explode(F.array_distinct(F.array("p_brand", "p_type"))).alias("k")).where("k is not null")
    s = social.tag_scores(_marks(spark, d), tags)
    return s.select("u", "i", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("item_mean", "tag_mean", "blended")])


def trust_paths(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers trust the five that most often follow them in an order, and those whom these trust."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    then = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    n = li.join(then, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_suppkey").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")).where("a <> b")
    total = n.groupBy("a").agg(F.sum("n").alias("all"))
    edges = n.join(total, "a").select("a", "b", (F.col("n") / F.col("all")).alias("w"))
    return social.trust_within(social.strongest(edges, 5), 2).select("a", "b", F.round("w", 8).alias("w"))


def attack_models(spark: SparkSession, d: str) -> DataFrame:
    """How fake profiles of each kind move the mean of a target part, with their number and their mean rating."""
    r = _r(spark, d)
    target = r.agg(F.min("i")).first()[0] or 0
    part = table(spark, d, "part").select(F.col("p_partkey").alias("i"), "p_brand")
    segment = part.join(part.where(F.col("i") == target).select("p_brand"), "p_brand", "left_semi").select("i")
    before = r.where(F.col("i") == target).agg(F.avg("r").alias("before"), F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))

    def one(kind: str) -> DataFrame:
        fake = social.attack(r, target, kind, segment)
        told = fake.agg(F.countDistinct("u").alias("profiles"), F.count(F.lit(1)).alias("rows"), F.avg("r").alias("mean"), F.sum(F.when(F.col("i") == target, F.col("r"))).alias("fs"), F.count(F.when(F.col("i") == target, 1)).alias("fn"))
        return told.crossJoin(before).select(F.lit(kind).alias("kind"), "profiles", "rows", F.round("mean", 6).alias("mean"), F.round((F.col("s") + F.col("fs")) / (F.col("n") + F.col("fn")) - F.col("before"), 6).alias("shift"))  # one row each

    return reduce(DataFrame.unionByName, [one(k) for k in social.ATTACKS])


def item_cf_cosine(spark: SparkSession, d: str) -> DataFrame:
    return C.item_cosine(_r(spark, d)).select("a", "b", "n", F.round("sim", 6).alias("sim"))


def item_cf_predict(spark: SparkSession, d: str) -> DataFrame:
    """Ratings foretold from the user's own ratings of like items."""
    r = _r(spark, d)
    return C.predict_from_items(r, C.item_cosine(r)).select("u", "i", F.round(F.col("prediction") + 1e-7, 5).alias("prediction"))


def serendipity(spark: SparkSession, d: str) -> DataFrame:
    """Mean gain of a line's own share over its part's popularity, where it is relevant."""
    li = table(spark, d, "lineitem")
    n = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("most"))
    x = li.join(n, "l_partkey").crossJoin(F.broadcast(most))  # one row
    return x.agg(F.round(F.avg(F.greatest(F.col("l_quantity") / 50 - F.col("n") / F.col("most"), F.lit(0.0)) * (F.col("l_returnflag") == "R").cast("double")), 6).alias("serendipity"))


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    mean = _ratings(spark, d).groupBy("item").agg(F.avg("rating").alias("a"))
    rated = p.join(mean, F.col("p_partkey") == F.col("item")).select("p_brand", "item", F.round("a", 9).alias("score"))
    return rated, p.select("p_brand", F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("score"))


def hybrid_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The three best parts of every brand by rating and by size, side by side."""
    rated, sized = _rankings(spark, d)
    return social.mixed({"rated": rated, "sized": sized}, "p_brand", "item", 3)


def hybrid_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the parts that ratings let through."""
    rated, sized = _rankings(spark, d)
    return social.cascade(rated.withColumn("score", F.when(F.col("score") >= 5, F.col("score")).otherwise(0.0)), sized, ["p_brand", "item"])


def tfidf_variants(spark: SparkSession, d: str) -> DataFrame:
    """Raw counts by the natural logarithm, and shares of the commonest term by the binary one."""
    docs = table(spark, d, "documents").where("body_en is not null").select("doc_id", text.terms(F.col("body_en")).alias("w"))
    t = text.term_weights(text.term_counts(docs, "doc_id", F.col("w")), "doc_id", docs.count())
    return t.select("doc_id", "term", F.round("raw", 6).alias("raw"), F.round("relative", 6).alias("relative"))


def sampling_priorities(spark: SparkSession, d: str) -> DataFrame:
    """The chance of every event in sampling by its value."""
    return social.priorities(table(spark, d, "events").select("event_id", "value").where("value is not null"), F.abs("value") + 0.01, 0.6).select("event_id", F.round("p", 12).alias("p"))


#: Relations allowed between a segment of customers and a status of orders.
SCHEMA = (("BUILDING", "1-URGENT", "F"), ("BUILDING", "1-URGENT", "O"), ("MACHINERY", "5-LOW", "O"), ("AUTOMOBILE", "2-HIGH", "P"), ("AUTOMOBILE", "2-HIGH", "P"))


def allowed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as relations of a segment, a priority and a status: those that the schema allows."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rel = o.select("o_orderkey", F.col("c_mktsegment").alias("head_type"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("tail_type"))
    return social.allowed_relations(rel, spark.createDataFrame(SCHEMA, "head_type string, predicate string, tail_type string"))


def beam_decode(spark: SparkSession, d: str) -> DataFrame:
    """The three likeliest goes-on of a word by pairs of words, five words long."""
    words = table(spark, d, "documents").where("body_en is not null").select(text.terms(F.col("body_en")).alias("w"))
    return language_model.beam(words, "w", "annual", 5, 3).select("rank", "words", F.round("logp", 6).alias("logp"))


def online_learners(spark: SparkSession, d: str) -> DataFrame:
    """Perceptron and Winnow on the embeddings, and a tree, by the share of rows they label right."""
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null").select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    rows = []
    for kind in ("perceptron", "winnow"):
        w = models.fit_online(e, "embedding", "y", kind)
        rows.append(e.select(F.lit(kind).alias("model"), (models.online_score(F.col("embedding"), w, kind) == F.col("y")).cast("double").alias("ok")))
    rows.append(models.tree_labels(e, "embedding", "y").select(F.lit("tree").alias("model"), (F.col("said") == F.col("y")).cast("double").alias("ok")))
    return reduce(DataFrame.unionByName, rows).groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("ok"), 6).alias("right"))


QUERIES = {
    f.__name__: f
    for f in (
        tag_scores, trust_paths, attack_models, item_cf_cosine, item_cf_predict, serendipity, hybrid_mixed, hybrid_cascade, tfidf_variants, sampling_priorities, allowed_relations, beam_decode, online_learners,
    )
}

_R0 = "r0 as (select o_custkey as u, l_partkey as i, l_quantity / 5 as rating from lineitem join orders on l_orderkey = o_orderkey), r as (select u, i, avg(rating) as r from r0 group by 1, 2)"
_COS = f"""with {_R0}, s as (select a.i as a, b.i as b, count(*) as n, sum(a.r * b.r) as ab from r a join r b on a.u = b.u and a.i < b.i group by 1, 2 having count(*) >= 3),
    q as (select i, sqrt(sum(r * r)) as q from r group by 1), sim as (select a, b, n, case when x.q * y.q > 1e-12 then ab / (x.q * y.q) else 0.0 end as sim from s join q x on x.i = a join q y on y.i = b)"""

SQL = {
    "tag_scores": f"""with {_R0}, m as (select u, i, floor(rating / 2) as r from r0), g as (select distinct p_partkey as i, unnest([p_brand, p_type]) as k from part), n as (select u, k, r, count(*) as n from m join g using (i) group by 1, 2, 3),
        a as (select k, sum(n) as "all" from n group by 1), w as (select u, k, r, n / ln("all") as w from n join a using (k) where "all" > 1), p as (select distinct u, i from m),
        s as (select p.u, p.i, sum(r * w) / sum(w) as t from p join g on g.i = p.i join w on w.u = p.u and w.k = g.k group by 1, 2), im as (select i, avg(r) as im from m group by 1)
        select u, i, round(im + 1e-9, 6) as item_mean, round(t + 1e-9, 6) as tag_mean, round(0.5 * im + 0.5 * t + 1e-9, 6) as blended from s join im using (i)""",
    "trust_paths": """with n as (select x.l_suppkey as a, y.l_suppkey as b, count(*) as n from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1 where x.l_suppkey <> y.l_suppkey group by 1, 2),
        w as (select a, b, n / sum(n) over (partition by a) as w from n), e as (select a, b, w from (select *, row_number() over (partition by a order by w desc, b) as k from w) where k <= 5),
        p as (select * from e union all select x.a, y.b, x.w * y.w from e x join e y on x.b = y.a where x.a <> y.b) select a, b, round(max(w), 8) as w from p group by 1, 2""",
    "attack_models": f"""with {_R0}, g as (select min(i) as t from r), b as (select avg(r) as before, sum(r) as s, count(*) as n from r, g where i = t), z as (select avg(r) as mean, stddev_pop(r) as sd, cast(greatest(ceil(count(distinct u) * 0.03), 1) as bigint) as k from r),
        it as (select i, avg(r) as m, count(*) as n from r, g where i <> t group by 1), h as (select * from it order by {order_hash_sql('i')}, i limit 50), w as (select * from it order by n desc, i limit 50),
        f as (select unnest(range(1, (select k from z) + 1)) as f), brand as (select p_brand from part, g where p_partkey = t),
        fill as (select 'random' as kind, f, greatest(least(mean + sd * ({order_hash_sql('i * 1009 + f')} / 4294967296.0 * 2 - 1), 10.0), 0.0) as v from h, f, z union all select 'average', f, m from h, f union all select 'bandwagon', f, 10.0 from w, f
          union all select 'segment', f, case when i in (select p_partkey from part join brand using (p_brand)) then 10.0 else 0.0 end from h, f union all select 'love_hate', f, 10.0 from h, f),
        x as (select kind, f, v, 0 as aimed from fill union all select kind, f, case when kind = 'love_hate' then 0.0 else 10.0 end, 1 from (select distinct kind from fill), f)
        select kind, count(distinct f) as profiles, count(*) as "rows", round(avg(v), 6) as mean, round((any_value(s) + sum(v * aimed)) / (any_value(n) + sum(aimed)) - any_value(before), 6) as shift from x, b group by 1""",
    "item_cf_cosine": f"{_COS} select a, b, n, round(sim, 6) as sim from sim",
    "item_cf_predict": f"{_COS}, t as (select a as i, b as j, sim from sim where sim > 1e-6 union all select b, a, sim from sim where sim > 1e-6) select r.u, t.j as i, round(sum(sim * r) / sum(sim) + 1e-7, 5) as prediction from r join t on t.i = r.i group by 1, 2",
    "serendipity": """with n as (select l_partkey, count(*) as n from lineitem group by 1) select round(avg(greatest(l_quantity / 50 - n / (select max(n) from n), 0.0) * cast(l_returnflag = 'R' as double)), 6) as serendipity from lineitem join n using (l_partkey)""",
    "hybrid_mixed": f"""with {_R0}, x as (select p_brand, i as item, round(avg(rating), 9) as score, 'rated' as source from r0 join part on p_partkey = i group by 1, 2 union all select p_brand, p_partkey, cast(p_size as double), 'sized' from part)
        select * from (select *, row_number() over (partition by source, p_brand order by score desc, item) as rank from x) where rank <= 3""",
    "hybrid_cascade": f"with {_R0}, g as (select i, round(avg(rating), 9) as a from r0 group by 1) select p_brand, p_partkey as item, case when coalesce(a, 0) >= 5 then cast(p_size as double) else 0.0 end as score from part left join g on i = p_partkey",
    "tfidf_variants": """with t as (select doc_id, unnest(list_filter(string_split_regex(lower(body_en), '[^a-z0-9а-яёіїєґ]+'), lambda x: length(x) >= 2)) as term from documents where body_en is not null), c as (select doc_id, term, count(*) as tf from t group by 1, 2),
        df as (select term, count(*) as df from c group by 1), n as (select count(*) as n from documents where body_en is not null)
        select doc_id, term, round(tf * ln(n / df), 6) as raw, round(tf / max(tf) over (partition by doc_id) * log2(n / df), 6) as relative from c join df using (term), n""",
    "sampling_priorities": "with w as (select event_id, power(abs(value) + 0.01, 0.6) as w from events where value is not null) select event_id, round(w / sum(w) over (), 12) as p from w",
    "allowed_relations": "select o_orderkey, c_mktsegment as head_type, o_orderpriority as predicate, o_orderstatus as tail_type from orders join customer on o_custkey = c_custkey where (c_mktsegment, o_orderpriority, o_orderstatus) in (" + ", ".join(str(x) for x in dict.fromkeys(SCHEMA)) + ")",
}
