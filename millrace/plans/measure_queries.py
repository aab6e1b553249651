"""Ranking measures, neighbours, language models and feature selection over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import metrics
from millrace.operators import collaborative as C
from millrace.operators import language_model as L
from millrace.operators import models, text
from millrace.operators.recommend import against_all, dot
from millrace.operators.relational import order_hash


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """Line items as ratings of parts by customers, a fifth of the quantity each."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item"), (F.col("l_quantity") / 5).alias("rating"))


def damped_mean(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    mu = r.agg(F.avg("rating")).scalar()
    return r.groupBy("item").agg(F.round((F.sum("rating") + mu * 5) / (F.count(F.lit(1)) + 5), 6).alias("damped"), (F.rint(F.round(F.avg("rating"), 9)) * 10).alias("score"))


def lift_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Brands that meet in an order, with their lift."""
    b = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return C.lift_pairs(b, "l_orderkey", "p_brand").select("a", "b", "n", F.round("lift", 6).alias("lift"))


def user_cf_pearson(spark: SparkSession, d: str) -> DataFrame:
    return C.user_pearson(C.one_rating(_ratings(spark, d), "user_id", "item")).select("a", "b", "n", F.round("sim", 5).alias("sim"))


def user_cf_predict(spark: SparkSession, d: str) -> DataFrame:
    r = C.one_rating(_ratings(spark, d), "user_id", "item")
    return C.predict_from_users(r, C.user_pearson(r)).select("u", "i", F.round(F.col("prediction") + 1e-7, 5).alias("prediction"))


def item_cf_adjusted_cosine(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d).repartition("user_id")  # one shuffle for a user's ratings and baskets
    return C.item_adjusted_cosine(C.one_rating(r, "user_id", "item")).select("a", "b", "n", F.round("sim", 5).alias("sim"))


def attack_shift(spark: SparkSession, d: str) -> DataFrame:
    """How far fake users with mean ratings move the mean of a target item."""
    r = C.one_rating(_ratings(spark, d), "user_id", "item")
    target = r.agg(F.min("i")).first()[0] or 0
    before = r.where(F.col("i") == target).agg(F.avg("r").alias("before"))
    after = C.average_attack(r, target).where(F.col("i") == target).agg(F.avg("r").alias("after"))
    return before.crossJoin(after).select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("shift"))  # one row each


def hot_posts(spark: SparkSession, d: str) -> DataFrame:
    """Vote and decay scores of items: purchases up, errors down."""
    e = table(spark, d, "events").groupBy("user_id").agg(
        F.sum((F.col("event_type") != "error").cast("int")).alias("up"), F.sum((F.col("event_type") == "error").cast("int")).alias("down"), F.max(F.unix_timestamp("ts")).alias("at")
    )
    first, last = e.agg(F.min("at")).scalar(), e.agg(F.max("at")).scalar()
    x = e.withColumn("age", (F.col("at") - first).cast("double")).withColumn("hours", (last - F.col("at")) / 3600.0)
    h = C.hot_score(x, "up", "down", "age").withColumnRenamed("score", "hot")
    return C.decay_score(h, "up", "down", "hours").select("user_id", F.round("hot", 6).alias("hot"), F.round("score", 6).alias("decayed"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every order ranked by price, with the quantity's tens as gain."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("rank"), F.floor(F.col("l_quantity") / 20).cast("double").alias("gain"))


def ranked_quality(spark: SparkSession, d: str) -> DataFrame:
    """Average precision, reciprocal rank, precision, DCG, nDCG and half-life utility of every list."""
    q = metrics.ranked_quality(_lists(spark, d), "l_orderkey", "rank", "gain", 5)
    return q.select("l_orderkey", *[F.round(c, 6).alias(c) for c in q.columns if c != "l_orderkey"])


def map_score(spark: SparkSession, d: str) -> DataFrame:
    q = metrics.ranked_quality(_lists(spark, d), "l_orderkey", "rank", "gain", 5)
    return q.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ap", "rr", "ndcg")])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(table(spark, d, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").select(F.round("spearman", 6).alias("spearman"))


def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the mean rating of a part as a prediction of its ratings."""
    r = _ratings(spark, d)
    m = r.groupBy("item").agg(F.avg("rating").alias("p"))
    e = metrics.errors(r.join(m, "item"), "rating", "p")
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


def micro_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Return flags against line states read as flags."""
    x = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "F", "A").otherwise("N").alias("said"))
    m = metrics.micro_macro(x, "l_returnflag", "said")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def binary_measures(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.binary_counts(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount") > 0.05)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def coverage_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Share of parts that lists of the five dearest lines reach, and the mean difference of brands within a list."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    top = li.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))).where("r <= 5")
    parts = table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    # pairs of equal brands come from brand counts, without building pairs
    per = top.groupBy("l_orderkey", "p_brand").agg(F.count(F.lit(1)).alias("c")).groupBy("l_orderkey").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    div = per.where("n > 1").agg(F.round(F.avg(1 - F.col("same") / (F.col("n") * (F.col("n") - 1) / 2)), 6).alias("diversity"))
    cov = top.agg(F.round(F.countDistinct("l_partkey") / parts, 6).alias("coverage"))
    return cov.crossJoin(div)  # one row each


def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of parts mixed by weight, and switched to the second where the first has few rows."""
    g = _ratings(spark, d).groupBy("item").agg(F.avg("rating").alias("a"), F.count(F.lit(1)).alias("n"))
    p = g.join(table(spark, d, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") / 5).alias("b")), "item")
    return p.select("item", F.round(0.7 * F.col("a") + 0.3 * F.col("b"), 6).alias("weighted"), F.round(F.when(F.col("n") >= 20, F.col("a")).otherwise(F.col("b")), 6).alias("switched"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("body_en is not null").select("doc_id", "source", text.terms(F.col("body_en")).alias("w"))


def _unigrams(t: DataFrame) -> DataFrame:
    return t.select(F.explode("w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))


def bigram_lm(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return L.bigram_model(L.bigrams(t, "doc_id", "w"), _unigrams(t)).select("first", "second", "n", *[F.round(c, 8).alias(c) for c in ("mle", "add_one", "interpolated")])


def perplexity(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return L.perplexity(L.bigram_model(L.bigrams(t, "doc_id", "w"), _unigrams(t))).select(F.round("entropy", 5).alias("entropy"), F.round("perplexity", 4).alias("perplexity"))


def zipf(spark: SparkSession, d: str) -> DataFrame:
    return L.zipf(_unigrams(_tokens(spark, d)))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title_en <> ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.array_distinct(text.terms(F.col("title_en"))).alias("w"))
    return L.contingency(docs.select("doc_id", "source"), docs.select("doc_id", F.explode("w").alias("term")), "source")


def chi2_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.chi_square(_cells(spark, d)).groupBy("term").agg(F.round(F.max("chi2"), 5).alias("chi2"))


def info_gain(spark: SparkSession, d: str) -> DataFrame:
    return L.information_gain(_cells(spark, d)).select("term", F.round("gain", 6).alias("gain"))


def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return L.mutual_information(_cells(spark, d)).select("term", "label", F.round("mi", 6).alias("mi"))


def whole_text(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, source, t``: title and body of every document in all languages."""
    t = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in ("title_en", "body_en", "title_ru", "body_ru")])
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), t.alias("t")).where("t <> ''")


def _text_cells(spark: SparkSession, d: str) -> DataFrame:
    return L.contingency_of_arrays(whole_text(spark, d).select("source", F.array_distinct(text.terms(F.col("t"))).alias("w")), "w", "source")


def text_chi2_terms(spark: SparkSession, d: str) -> DataFrame:
    """``chi2_terms`` over whole texts."""
    return L.chi_square(_text_cells(spark, d)).groupBy("term").agg(F.round(F.max("chi2"), 5).alias("chi2"))


def text_info_gain(spark: SparkSession, d: str) -> DataFrame:
    """``info_gain`` over whole texts."""
    return L.information_gain(_text_cells(spark, d)).select("term", F.round("gain", 6).alias("gain"))


def text_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """``mutual_information`` over whole texts."""
    return L.mutual_information(_text_cells(spark, d)).select("term", "label", F.round("mi", 6).alias("mi"))


def title_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Logarithm of the BLEU of each English title against its whole body, as the brevity penalty of a title leaves few digits; null for 0."""
    t = table(spark, d, "documents").where("title_en <> ''").select("doc_id", text.terms(F.col("title_en")).alias("c"), text.terms(F.col("body_en")).alias("r"))
    score = L.bleu(t.where("size(c) > 0 and size(r) > 0"), "c", "r")
    return score.select("doc_id", F.round(F.log(F.nullif("bleu", F.lit(0.0))), 6).alias("log_bleu"))


def trigram_lm(spark: SparkSession, d: str) -> DataFrame:
    """What follows every two words of English bodies."""
    return L.ngram_model(_tokens(spark, d), "w", 3).select("context", "word", "n", F.round("p", 8).alias("p"))


def byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first five merges of byte-pair encoding over English words."""
    merges = L.byte_pair_merges(_unigrams(_tokens(spark, d)), 5)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "step int, a string, b string")


def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest others of every vector whose id is divisible by 100."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"), F.col("norm").alias("m"))
    s = against_all(v, q, "vec_id").where("vec_id <> query_id").select("query_id", "vec_id", F.round(dot(F.col("embedding"), F.col("e")) / (F.col("norm") * F.col("m")), 5).alias("score"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("r <= 5").drop("r")


def embedding_knn_label(spark: SparkSession, d: str) -> DataFrame:
    """Label of every vector whose id is divisible by 100, by the vote of its nearest."""
    v = table(spark, d, "embeddings")
    return models.nearest_labels(v, v.where("vec_id % 100 = 0"))


def als_factors(spark: SparkSession, d: str) -> DataFrame:
    return models.factors(_ratings(spark, d).select("user_id", F.col("item").alias("book_id"), "rating"))


def naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    """Script of every text's language told by its words."""
    docs = table(spark, d, "documents").where("lang in ('en', 'ru') and text <> ''").select("doc_id", "text", (F.col("lang") == "ru").cast("double").alias("label"))
    part = docs.withColumn("dev", order_hash(F.col("doc_id")) % 5 == 0)
    return models.naive_bayes(part.where("not dev"), part.where("dev")).select("doc_id", "label", "prediction")


def svd_lsa(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts on the first singular vectors of their words."""
    return models.text_components(whole_text(spark, d), "t").select("doc_id", "components")


QUERIES = {
    f.__name__: f
    for f in (
        damped_mean, lift_pairs, user_cf_pearson, user_cf_predict, item_cf_adjusted_cosine, attack_shift, hot_posts, ranked_quality, map_score, spearman, prediction_errors, micro_macro_f1, binary_measures,
        coverage_diversity, hybrid_scores, bigram_lm, perplexity, zipf, chi2_terms, info_gain, mutual_information, text_chi2_terms, text_info_gain, text_mutual_information, title_bleu, trigram_lm, byte_pairs, embedding_cosine_topk, embedding_knn_label, als_factors, naive_bayes, svd_lsa,
    )
}

_R = "r0 as (select o_custkey as user_id, l_partkey as item, l_quantity / 5 as rating from lineitem join orders on l_orderkey = o_orderkey), r as (select user_id as u, item as i, avg(rating) as r from r0 group by 1, 2)"
_PEAR = f"""{_R}, m as (select u, avg(r) as m from r group by 1), c as (select u, i, r - m as d from r join m using (u)),
    s as (select a.u as a, b.u as b, count(*) as n, sum(a.d * b.d) as ab, sum(a.d * a.d) as aa, sum(b.d * b.d) as bb from c a join c b on a.i = b.i and a.u < b.u group by 1, 2 having count(*) >= 3),
    sim as (select a, b, n, case when aa > 1e-12 and bb > 1e-12 then ab / sqrt(aa * bb) else 0.0 end as sim from s)"""
_LISTS = """li as (select l_orderkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as rank, floor(l_quantity / 20) as gain from lineitem),
    x as (select *, cast(gain > 0 as double) as hit, sum(cast(gain > 0 as double)) over (partition by l_orderkey order by rank) as hits, row_number() over (partition by l_orderkey order by gain desc, rank) as best, sum(cast(gain > 0 as double)) over (partition by l_orderkey) as al from li),
    q as (select l_orderkey, coalesce(sum(hit * hits / rank) / nullif(sum(hit), 0), 0) as ap, coalesce(max(hit / rank), 0) as rr, sum(case when rank <= 5 then hit else 0 end) / 5 as p_at_k,
      coalesce(sum(case when rank <= al then hit else 0 end) / nullif(max(al), 0), 0) as r_precision, sum(gain / greatest(1.0, log2(rank))) as dcg,
      coalesce(sum(gain / greatest(1.0, log2(rank))) / nullif(sum(gain / greatest(1.0, log2(best))), 0), 0) as ndcg, sum(gain / power(2.0, (rank - 1) / 4.0)) as half_life from x group by 1)"""
_W = "list_filter(string_split_regex(lower({0}), '[^a-z0-9а-яёіїєґ]+'), lambda x: length(x) >= 2)"
_LM = f"""t as (select doc_id, {_W.format('body_en')} as w from documents where body_en is not null), u as (select term, count(*) as c from (select unnest(w) as term from t) group by 1),
    b as (select f as first, s as second, count(*) as n from (select unnest(w[1:len(w) - 1]) as f, unnest(w[2:len(w)]) as s from t where len(w) > 1) group by 1, 2),
    f as (select first, sum(n) as nf from b group by 1), z as (select sum(c) as tokens, count(*) as types from u),
    lm as (select first, second, n, n / nf as mle, (n + 1) / (nf + types) as add_one, 0.7 * n / nf + 0.3 * c / tokens as interpolated from b join f using (first) join u on term = second, z)"""
_CELLS = f"""d as (select doc_id, coalesce(source, '') as source, list_distinct({_W.format('title_en')}) as w from documents where title_en <> ''), tt as (select doc_id, source, unnest(w) as term from d),
    nl as (select source as label, count(*) as n_label from d group by 1), nt as (select term, count(*) as n_term from tt group by 1), ab as (select term, source as label, count(*) as a from tt group by 1, 2),
    cells as (select nt.term, nl.label, coalesce(a, 0) as a, n_term, n_label, (select count(*) from d) as n from nt cross join nl left join ab on ab.term = nt.term and ab.label = nl.label)"""
_IG = lambda j, m, t: f"case when {j} > 0 then {j} / n * log2({j} * n / (({m}) * {t})) else 0 end"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"

SQL = {
    "damped_mean": f"with {_R} select item, round((sum(rating) + 5 * (select avg(rating) from r0)) / (count(*) + 5), 6) as damped, round_even(round(avg(rating), 9), 0) * 10 as score from r0 group by 1",
    "lift_pairs": """with b as (select distinct l_orderkey as k, p_brand as x from lineitem join part on l_partkey = p_partkey), s as (select x, count(*) as n from b group by 1)
        select p.a, p.b, p.n, round(p.n * (select count(distinct k) from b) / (sa.n * sb.n), 6) as lift from (select a.x as a, b.x as b, count(*) as n from b a join b b on a.k = b.k and a.x < b.x group by 1, 2 having count(*) >= 2) p
        join s sa on sa.x = p.a join s sb on sb.x = p.b""",
    "user_cf_pearson": f"with {_PEAR} select a, b, n, round(sim, 5) as sim from sim",
    "user_cf_predict": f"with {_PEAR}, p as (select a as u, b as v, sim from sim where sim > 1e-6 union all select b, a, sim from sim where sim > 1e-6), g as (select p.u, c.i, sum(sim * d) as num, sum(sim) as den from p join c on c.u = p.v group by 1, 2) select u, i, round(m + num / den + 1e-7, 5) as prediction from g join m using (u)",
    "item_cf_adjusted_cosine": f"""with {_R}, m as (select u, avg(r) as m from r group by 1), c as (select u, i, r - m as d from r join m using (u)),
        s as (select a.i as a, b.i as b, count(*) as n, sum(a.d * b.d) as ab, sum(a.d * a.d) as aa, sum(b.d * b.d) as bb from c a join c b on a.u = b.u and a.i < b.i group by 1, 2 having count(*) >= 3)
        select a, b, n, round(case when aa > 1e-12 and bb > 1e-12 then ab / sqrt(aa * bb) else 0.0 end, 5) as sim from s""",
    "attack_shift": f"""with {_R}, g as (select min(i) as t from r), b as (select avg(r) as before, sum(r) as s, count(*) as n from r, g where i = t), f as (select greatest(ceil(count(distinct u) * 0.03), 1) as k from r)
        select round(before, 6) as before, round((s + 10 * k) / (n + k), 6) as after, round((s + 10 * k) / (n + k) - before, 6) as shift from b, f""",
    "hot_posts": """with e as (select user_id, sum(cast(event_type <> 'error' as int)) as up, sum(cast(event_type = 'error' as int)) as down, max(floor(epoch(ts))) as seen from events group by 1), x as (select *, up - down as net, seen - (select min(seen) from e) as age, ((select max(seen) from e) - seen) / 3600.0 as hours from e)
        select user_id, round(log10(greatest(1.0, abs(net))) + sign(net) * age / 45000.0, 6) as hot, round(power(greatest(net - 1, 0), 0.8) / power(hours + 2.0, 1.8), 6) as decayed from x""",
    "ranked_quality": f"with {_LISTS} select l_orderkey, " + ", ".join(f"round({c}, 6) as {c}" for c in ("ap", "rr", "p_at_k", "r_precision", "dcg", "ndcg", "half_life")) + " from q",
    "map_score": f"with {_LISTS} select round(avg(ap), 6) as ap, round(avg(rr), 6) as rr, round(avg(ndcg), 6) as ndcg from q",
    "spearman": "with a as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as x, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as y from lineitem) select round(corr(x, y), 6) as spearman from a",
    "prediction_errors": f"with {_R}, e as (select rating - avg(rating) over (partition by item) as d from r0) select round(avg(abs(d)), 6) as mae, round(avg(d * d), 6) as mse, round(sqrt(avg(d * d)), 6) as rmse from e",
    "micro_macro_f1": """with x as (select l_returnflag as g, case when l_linestatus = 'F' then 'A' else 'N' end as p from lineitem), l as (select g as label from x union select p from x),
        c as (select label, (select count(*) from x where p = label) as said, (select count(*) from x where g = label) as "real", (select count(*) from x where g = label and p = label) as hit from l),
        m as (select sum(hit) / sum(said) as pm, sum(hit) / sum("real") as rm, avg(case when said > 0 then hit / said else 0 end) as pa, avg(case when "real" > 0 then hit / "real" else 0 end) as ra from c)
        select round(pm, 6) as p_micro, round(rm, 6) as r_micro, round(2 * pm * rm / (pm + rm), 6) as f1_micro, round(pa, 6) as p_macro, round(ra, 6) as r_macro, round(2 * pa * ra / (pa + ra), 6) as f1_macro from m""",
    "binary_measures": """with m as (select count(*) filter (l_returnflag = 'R' and l_discount > 0.05) as tp, count(*) filter (l_returnflag <> 'R' and l_discount > 0.05) as fp, count(*) filter (l_returnflag = 'R' and l_discount <= 0.05) as fn, count(*) as n from lineitem),
        x as (select tp / (tp + fp) as p, tp / (tp + fn) as r, (n - fp - fn) / n as acc from m) select round(p, 6) as precision, round(r, 6) as recall, round(acc, 6) as accuracy, round(2 * p * r / (p + r), 6) as f1, round(5 * p * r / (4 * p + r), 6) as f_beta from x""",
    "coverage_diversity": """with t as (select * from (select l_orderkey, l_partkey, p_brand, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as r from lineitem join part on l_partkey = p_partkey) where r <= 5),
        p as (select a.l_orderkey, avg(cast(a.p_brand <> b.p_brand as double)) as v from t a join t b on a.l_orderkey = b.l_orderkey and a.r < b.r group by 1)
        select (select round(count(distinct l_partkey) / (select count(*) from part), 6) from t) as coverage, (select round(avg(v), 6) from p) as diversity""",
    "hybrid_scores": f"with {_R}, g as (select item, avg(rating) as a, count(*) as n from r0 group by 1) select item, round(0.7 * a + 0.3 * (p_size / 5), 6) as weighted, round(case when n >= 20 then a else p_size / 5 end, 6) as switched from g join part on p_partkey = item",
    "title_bleu": f"""with t as (select doc_id, {_W.format('title_en')} as c, {_W.format("coalesce(body_en, '')")} as r from documents where title_en <> ''), g as (select *, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) as c2, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) as r2 from t where len(c) > 0 and len(r) > 0),
        p as (select doc_id, len(c) as lc, len(r) as lr, list_sum(list_transform(list_distinct(c), lambda g: least(len(list_filter(c, lambda x: x = g)), len(list_filter(r, lambda x: x = g))))) / len(c) as p1,
              case when len(c2) > 0 then list_sum(list_transform(list_distinct(c2), lambda g: least(len(list_filter(c2, lambda x: x = g)), len(list_filter(r2, lambda x: x = g))))) / len(c2) else 0 end as p2 from g)
        select doc_id, case when p1 * p2 > 0 then round(ln(case when lc >= lr then 1.0 else exp(1.0 - lr / lc) end * sqrt(p1 * p2)), 6) end as log_bleu from p""",
    "trigram_lm": f"""with t as (select {_W.format('body_en')} as w from documents where body_en is not null), g as (select unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i] || ' ' || w[i + 1], w[i + 2]])) as g from t where len(w) >= 3),
        c as (select g[1] as context, g[2] as word, count(*) as n from g group by 1, 2) select context, word, n, round(n / sum(n) over (partition by context), 8) as p from c""",
    "bigram_lm": f"with {_LM} select first, second, n, round(mle, 8) as mle, round(add_one, 8) as add_one, round(interpolated, 8) as interpolated from lm",
    "perplexity": f"with {_LM}, h as (select -sum(n * log2(interpolated)) / sum(n) as h from lm) select round(h, 5) as entropy, round(power(2.0, h), 4) as perplexity from h",
    "zipf": f"with {_LM}, k as (select term, c, row_number() over (order by c desc, term) as rank from u) select term, c, rank, rank * c as product from k",
    "chi2_terms": f"with {_CELLS}, v as (select *, n_term - a as b, n_label - a as c, n - n_term - n_label + a as e from cells) select term, round(max(case when (a + b) * (c + e) * (a + c) * (b + e) > 0 then n * power(a * e - b * c, 2) / (cast(a + b as double) * (c + e) * (a + c) * (b + e)) else 0 end), 5) as chi2 from v where a > 0 group by 1",
    "info_gain": f"with {_CELLS} select term, round(sum({_IG('a', 'n_term', 'n_label')} + {_IG('(n_label - a)', 'n - n_term', 'n_label')}), 6) as gain from cells group by 1",
    "mutual_information": f"with {_CELLS} select term, label, round(log2(a * n / (n_term * n_label)), 6) as mi from cells where a > 0",
    "embedding_cosine_topk": f"""with v as (select vec_id, embedding as e, sqrt({_DOT.format('embedding', 'embedding')}) as n from embeddings), s as (select q.vec_id as query_id, v.vec_id, round({_DOT.format('v.e', 'q.e')} / (v.n * q.n), 5) as score from v join v q on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)
        select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 5""",
    "embedding_knn_label": f"""with v as (select vec_id, label, embedding as e, sqrt({_DOT.format('embedding', 'embedding')}) as n from embeddings), s as (select q.vec_id as qid, v.vec_id, v.label, round({_DOT.format('v.e', 'q.e')} / (v.n * q.n), 6) as score from v join v q on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
        t as (select qid, label, count(*) as n from (select *, row_number() over (partition by qid order by score desc, vec_id) as r from s) where r <= 5 group by 1, 2) select qid as vec_id, arg_min(label, struct_pack(a := -n, b := label)) as predicted from t group by 1""",
}

#: The same over titles and bodies of all languages.
_WHOLE = "(select doc_id, source, concat_ws(chr(10), nullif(title_en, ''), nullif(body_en, ''), nullif(title_ru, ''), nullif(body_ru, '')) as t from documents)"
SQL |= {f"text_{n}": SQL[n].replace(_W.format("title_en"), _W.format("t")).replace("from documents where title_en <> ''", f"from {_WHOLE} where t <> ''") for n in ("chi2_terms", "info_gain", "mutual_information")}
