"""N-gram models, Zipf ranks, feature selection, BLEU and byte-pair merges over counted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import durable


def bigrams(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """``first, second, n`` of neighbouring words, from arrays, without a window over the corpus."""
    rest = F.slice(F.col(tokens), 2, F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.filter(F.arrays_zip(F.col(tokens).alias("first"), rest.alias("second")), lambda p: p["second"].isNotNull())
    return df.select(id_col, F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n"))


def ngram_model(df: DataFrame, tokens: str, n: int) -> DataFrame:
    """``context, word, n, p``: what follows each run of ``n`` - 1 words, how often, and the share of that among all that follows it."""
    w = F.col(tokens)
    at = F.sequence(F.lit(1), F.size(w) - (n - 1))
    grams = F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, n - 1), " ").alias("context"), F.get(w, i + (n - 2)).alias("word")))
    counts = df.where(F.size(w) >= n).select(F.explode(grams).alias("g")).groupBy("g.context", "g.word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("context").agg(F.sum("n").alias("_all"))
    return counts.join(total, "context").select("context", "word", "n", (F.col("n") / F.col("_all")).alias("p"))


def bigram_model(pairs: DataFrame, unigrams: DataFrame, weight: float = 0.7) -> DataFrame:
    """``first, second, n, mle, add_one, interpolated`` probabilities."""
    total = unigrams.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"))
    firsts = pairs.groupBy("first").agg(F.sum("n").alias("n_first"))
    return (
        pairs.join(firsts, "first").join(unigrams.withColumnRenamed("term", "second"), "second").crossJoin(F.broadcast(total))  # one row
        .select("first", "second", "n", (F.col("n") / F.col("n_first")).alias("mle"), ((F.col("n") + 1) / (F.col("n_first") + F.col("types"))).alias("add_one"),
                (weight * F.col("n") / F.col("n_first") + (1 - weight) * F.col("c") / F.col("tokens")).alias("interpolated"))
    )


def perplexity(model: DataFrame) -> DataFrame:
    """One row: entropy in bits and perplexity of the interpolated model on its own pairs."""
    h = -F.sum(F.col("n") * F.log2("interpolated")) / F.sum("n")
    return model.agg(h.alias("entropy"), F.pow(F.lit(2.0), h).alias("perplexity"))


def zipf(unigrams: DataFrame) -> DataFrame:
    """``term, c, rank, product``: frequency times rank. Only frequencies are ranked globally, and they are few."""
    sizes = unigrams.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    base = sizes.select("c", (F.sum("k").over(Window.orderBy(F.desc("c"))) - F.col("k")).alias("before"))
    r = F.col("before") + F.row_number().over(Window.partitionBy("c").orderBy("term"))
    return unigrams.join(base, "c").select("term", "c", r.alias("rank"), (r * F.col("c")).alias("product"))


def contingency(docs: DataFrame, terms: DataFrame, label: str) -> DataFrame:
    """``term, label, a, n_term, n_label, n`` of the terms and labels that meet: documents with both, with each, and all.

    ``terms`` is (doc_id, term). Cells that do not meet are not built, as there is one for
    every term and label; what they add is a closed form of the others.
    """
    labels = docs.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    per = terms.join(docs.select("doc_id", label), "doc_id").groupBy("term", label).agg(F.count(F.lit(1)).alias("a"))
    df = per.groupBy("term").agg(F.sum("a").alias("n_term"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    return per.join(df, "term").join(labels, label).select("term", F.col(label).alias("label"), "a", "n_term", "n_label", n.alias("n"))


def contingency_of_arrays(docs: DataFrame, words: str, label: str) -> DataFrame:
    """``contingency`` of rows that hold their distinct words; the label goes with each word, so no text is joined or shuffled."""
    labels = docs.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    per = docs.select(label, F.explode(words).alias("term")).groupBy("term", label).agg(F.count(F.lit(1)).alias("a"))
    df = per.groupBy("term").agg(F.sum("a").alias("n_term"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    return per.join(df, "term").join(labels, label).select("term", F.col(label).alias("label"), "a", "n_term", "n_label", n.alias("n"))


def chi_square(cells: DataFrame) -> DataFrame:
    """``term, label, chi2`` of the pairs that meet."""
    a, b = F.col("a").cast("double"), (F.col("n_term") - F.col("a")).cast("double")
    c = (F.col("n_label") - F.col("a")).cast("double")
    d = F.col("n") - a - b - c
    den = (a + b) * (c + d) * (a + c) * (b + d)
    return cells.select("term", "label", F.when(den > 0, F.col("n") * F.pow(a * d - b * c, 2) / den).otherwise(0.0).alias("chi2"))


def information_gain(cells: DataFrame) -> DataFrame:
    """``term, gain``: bits that a term's presence tells of the label, labels that it never meets included."""
    def part(joint, mine, theirs):
        return F.when(joint > 0, joint / F.col("n") * F.log2(joint * F.col("n") / (mine * theirs))).otherwise(0.0)

    a, t, lab, n = (F.col(x).cast("double") for x in ("a", "n_term", "n_label", "n"))
    met = cells.groupBy("term").agg(F.sum(part(a, t, lab) + part(lab - a, n - t, lab)).alias("met"), F.sum(lab / n).alias("share"), F.max(t).alias("t"), F.max(n).alias("n"))
    rest = F.when(F.col("n") > F.col("t"), (1 - F.col("share")) * F.log2(F.col("n") / (F.col("n") - F.col("t")))).otherwise(0.0)
    return met.select("term", (F.col("met") + rest).alias("gain"))


def mutual_information(cells: DataFrame) -> DataFrame:
    """``term, label, mi``: pointwise, for pairs that meet."""
    return cells.where("a > 0").select("term", "label", F.log2(F.col("a") * F.col("n") / (F.col("n_term") * F.col("n_label"))).alias("mi"))


def bleu(df: DataFrame, candidate: str, reference: str, order: int = 2) -> DataFrame:
    """``df`` with ``bleu`` of token arrays: clipped n-gram precision up to ``order`` and the brevity penalty."""
    from millrace.operators.text import ngrams

    # n-grams are columns, so that they are built once a row and not once a kind
    grams = df.withColumns({f"_{side}{n}": ngrams(F.col(tokens), n) for side, tokens in (("c", candidate), ("r", reference)) for n in range(1, order + 1)})

    def precision(n: int):
        c, r = F.col(f"_c{n}"), F.col(f"_r{n}")
        kinds = F.array_distinct(c)
        count = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
        clipped = F.aggregate(F.transform(kinds, lambda g: F.least(count(c, g), count(r, g))), F.lit(0), lambda s, x: s + x)
        return F.when(F.size(c) > 0, clipped / F.size(c)).otherwise(0.0)

    ps = [precision(n) for n in range(1, order + 1)]
    product = ps[0]
    for p in ps[1:]:
        product = product * p
    brevity = F.when(F.size(candidate) >= F.size(reference), 1.0).otherwise(F.exp(1.0 - F.size(reference) / F.size(candidate)))
    out = grams.withColumn("bleu", brevity * F.pow(product, 1.0 / order))
    return out.drop(*[f"_{side}{n}" for side in "cr" for n in range(1, order + 1)])


def byte_pair_merges(unigrams: DataFrame, merges: int) -> list[tuple[str, str]]:
    """The first ``merges`` pairs that byte-pair encoding would join, by counted words; one pair reaches the driver a round."""
    from millrace.session import durable

    words = durable(unigrams.select(F.filter(F.split("term", ""), lambda x: x != "").alias("s"), "c"))
    out: list[tuple[str, str]] = []
    for _ in range(merges):
        rest = F.slice("s", 2, F.greatest(F.size("s"), F.lit(1)))
        pairs = F.filter(F.arrays_zip(F.col("s").alias("a"), rest.alias("b")), lambda p: p["b"].isNotNull())
        best = words.select(F.explode(pairs).alias("p"), "c").groupBy("p.a", "p.b").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if best is None:
            break
        a, b = best["a"], best["b"]
        out.append((a, b))
        empty = F.array().cast("array<string>")
        last = lambda acc: F.element_at(acc, -1)
        step = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc) == a) & (x == b), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x)))
        words = durable(words.select(F.aggregate("s", empty, step).alias("s"), "c"))
    return out


def beam(df: DataFrame, tokens: str, start: str, steps: int, width: int) -> DataFrame:
    """``rank, words, logp``: the ``width`` likeliest goes-on of ``start`` by pairs of words, kept to that many at every step; a width of 1 is greedy.

    Each word keeps its ``width`` likeliest followers beforehand, since no other can be among
    the best that go on from one state. Equal ones are ordered by the words.
    """
    pairs = bigrams(df.withColumn("_id", F.lit(0)), "_id", tokens)
    total = pairs.groupBy("first").agg(F.sum("n").alias("all"))
    best = Window.partitionBy("first").orderBy(F.desc("n"), "second")
    follow = pairs.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= width).join(total, "first").select(F.col("first").alias("last"), "second", F.log(F.col("n") / F.col("all")).alias("p"))
    follow = durable(follow)
    states = [(start, start, 0.0)]
    for _ in range(steps):
        now = df.sparkSession.createDataFrame(states, "words string, last string, logp double")
        longer = F.broadcast(now).join(follow, "last")  # at most ``width`` rows
        rows = longer.select(F.concat_ws(" ", "words", "second").alias("words"), F.col("second").alias("last"), (F.col("logp") + F.col("p")).alias("logp")).orderBy(F.desc(F.round("logp", 9)), "words").limit(width).collect()
        if not rows:
            break
        states = [(r["words"], r["last"], r["logp"]) for r in rows]
    return df.sparkSession.createDataFrame([(k + 1, w, p) for k, (w, _, p) in enumerate(states)], "rank int, words string, logp double")
