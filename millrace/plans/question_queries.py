"""Question normalising, expansion, lexical ranking and evaluation over ``questions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.functions import metrics
from millrace.functions import normalize as N
from millrace.operators import models, relational


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


def _lower_map(c: str):
    """Options under lower-case labels; of labels equal but for case the last one in order stays."""
    keys = F.array_sort(F.array_distinct(F.transform(F.map_keys(c), F.lower)))
    value = lambda k: F.coalesce(F.try_element_at(F.col(c), k), F.try_element_at(F.col(c), F.upper(k)))
    return F.map_from_arrays(keys, F.transform(keys, value))


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """One row for each id, the smallest row first; labels and letters in lower case, blank ids filled from the row."""
    q = _raw(spark, d)
    blank = F.coalesce(F.nullif(N.strip(F.col("id")), F.lit("")), F.concat_ws("_", F.lit("bbf_en"), "split_name", F.col("row_id").cast("string")))
    rows = q.select(
        "row_id", blank.alias("id"), "split_name", F.coalesce("dataset_source", F.lit("unknown")).alias("dataset_source"), N.question_text(F.col("question"), F.col("query_text")).alias("question"), "query_text",
        F.transform("choice_labels", F.lower).alias("choice_labels"), _lower_map("option_texts").alias("option_texts"), F.array_distinct(F.transform("gold_letters", F.lower)).alias("gold_letters"),
    )
    return relational.keep_first(rows, ["id"], [F.col("row_id")])


def question_rows(spark: SparkSession, d: str) -> DataFrame:
    n = normalised(spark, d)
    return n.select("row_id", "id", "dataset_source", F.array_join("choice_labels", ",").alias("labels"), F.array_join("gold_letters", ",").alias("gold"), F.length("question").alias("n_chars"))


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_first(_raw(spark, d).select("row_id", "id", "split_name"), ["id"], [F.col("row_id")])


def union_dedup_sources(spark: SparkSession, d: str) -> DataFrame:
    """Both sources, one row for each id, the first source before the second."""
    q = _raw(spark, d).select("row_id", "id", "dataset_source")
    return relational.union_first_source(q.where("dataset_source = 'finmmeval'"), q.where("dataset_source = 'bbf'"), "id", "row_id")


def options_of(questions: DataFrame) -> DataFrame:
    """A row for each option of normalised questions."""
    e = questions.select("id", "question", "option_texts", "gold_letters", F.posexplode("choice_labels").alias("pos", "label"))
    option = F.coalesce(F.try_element_at("option_texts", F.col("label")), F.lit(""))
    return e.select("id", "question", "pos", "label", option.alias("option_text"), N.pair_text(F.col("question"), F.col("label"), option).alias("feature_text"), F.array_contains("gold_letters", F.col("label")).cast("int").alias("target"))


def _options(spark: SparkSession, d: str) -> DataFrame:
    return options_of(normalised(spark, d))


def option_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each question and option with its text and whether it is right."""
    return _options(spark, d).drop("question")


def parse_option_map(spark: SparkSession, d: str) -> DataFrame:
    """Options read from the block of lines of every question."""
    m = _raw(spark, d).where("query_text is not null").select("row_id", N.parse_option_map(F.col("query_text")).alias("m"))
    return m.select("row_id", F.explode("m").alias("label", "option_text")).select("row_id", "label", F.regexp_replace("option_text", r"(?U)\s+", " ").alias("option_text"))


def parse_choices(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("row_id", F.array_join(N.parse_choices(F.col("choice_labels")), ",").alias("labels"))


def answer_letters(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("row_id", F.array_join(N.answer_letters(F.to_json("gold_letters")), ",").alias("letters"))


def map_indices(spark: SparkSession, d: str) -> DataFrame:
    """Gold letters turned into positions and back into labels."""
    q = normalised(spark, d)
    at = F.transform("gold_letters", lambda g: F.array_position("choice_labels", g).cast("int") - 1)
    return q.select("id", F.array_join(N.indices_to_labels(at, F.col("choice_labels")), ",").alias("labels"))


def answer_string(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d).select("id", N.labels_to_answer(F.col("gold_letters")).alias("answer"))


def question_summary(spark: SparkSession, d: str) -> DataFrame:
    """First two sentences of every question."""
    return normalised(spark, d).select("id", N.first_sentences(F.col("question")).alias("summary"))


def filter_4d(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the options a to d in order and one right answer among them."""
    return normalised(spark, d).where((F.array_join("choice_labels", "") == "abcd") & (F.size("gold_letters") == 1) & F.get("gold_letters", F.lit(0)).isin(*"abcd")).select("id", F.get("gold_letters", F.lit(0)).alias("gold"))


def labelled_by_source(spark: SparkSession, d: str) -> DataFrame:
    return normalised(spark, d).groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("gold_letters") > 0).cast("int")).alias("labelled"), F.sum(F.size("choice_labels")).alias("options"))


def _lexical(questions: DataFrame) -> DataFrame:
    e = questions.select("id", N.words(F.col("question")).alias("q"), "option_texts", F.posexplode("choice_labels").alias("pos", "label"))
    o = e.withColumn("o", N.words(F.try_element_at("option_texts", F.col("label"))))
    score = F.when(F.size("o") > 0, F.size(F.array_intersect("q", "o")) / F.size("o")).otherwise(0.0)
    return o.withColumn("score", score).groupBy("id").agg(F.array(F.min_by("label", F.struct(-F.col("score"), "pos"))).alias("labels"))


def lexical_overlap_predict(spark: SparkSession, d: str) -> DataFrame:
    """The option that shares most of its words with the question, the first of equals."""
    return _lexical(normalised(spark, d)).select("id", F.get("labels", F.lit(0)).alias("label"))


def most_common_letter(spark: SparkSession, d: str) -> DataFrame:
    """The commonest first gold letter, the smallest of equals, ``a`` where there is none."""
    g = normalised(spark, d).where("size(gold_letters) > 0").groupBy(F.get("gold_letters", F.lit(0)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.min_by("letter", F.struct(-F.col("n"), "letter")), F.lit("a")).alias("letter"))


def qa_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Lexical overlap and the commonest letter, evaluated side by side."""
    q = normalised(spark, d)
    letter = most_common_letter(spark, d).first()[0]
    registry = [("lexical", True, lambda _, dev: _lexical(dev)), ("common_letter", True, lambda _, dev: dev.select("id", F.array(F.lit(letter)).alias("labels"))), ("off", False, lambda _, dev: None)]
    out = metrics.answer_accuracy(q, models.run_registry(registry, q, q), ["model"])
    return out.select("model", "evaluated", F.round("exact_match", 6).alias("exact_match"), F.round("top1", 6).alias("top1"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Labelled questions split 80 to 20 within every first gold letter."""
    q = normalised(spark, d).where("size(gold_letters) > 0")
    return relational.stratified_split(q, F.get("gold_letters", F.lit(0)), "row_id", 0.2).select("id", "part")


def exact_fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the questions, to the row."""
    return relational.exact_sample(normalised(spark, d), "row_id", 0.1).select("id")


def submission(spark: SparkSession, d: str) -> DataFrame:
    """``id, answer`` of the lexical model, empty where it has no answer."""
    q = normalised(spark, d)
    return q.select("id").join(_lexical(q), "id", "left").select("id", N.labels_to_answer(F.coalesce("labels", F.array().cast("array<string>"))).alias("answer"))


def _train_dev(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = stratified_split(spark, d)
    rows = _options(spark, d).join(part, "id")
    return rows.where("part = 'train'"), rows.where("part = 'dev'")


def _pair(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, dev = _train_dev(spark, d)
        return models.best_labels(models.predict_pairs(models.fit_pairs(train, kind), dev)).select("id", F.get("labels", F.lit(0)).alias("label"))

    query.__doc__ = f"Best option of every held-out question by the {kind} model of pairs."
    return query


def multiclass_4d(spark: SparkSession, d: str) -> DataFrame:
    """The answer of four-option questions by machines over summary and options."""
    q = normalised(spark, d).join(filter_4d(spark, d), "id")
    body = F.concat_ws(" ", N.first_sentences(F.col("question")), F.concat_ws(" ", F.map_values("option_texts")))
    rows = q.select("id", "row_id", body.alias("feature_text"), (F.ascii("gold") - 97).cast("double").alias("answer"))
    split = relational.stratified_split(rows, F.col("answer"), "row_id", 0.2)
    train = split.where("part = 'train'")
    if train.isEmpty():
        return train.select("id", F.lit("a").alias("label"))
    out = models.fit_four_way(train).transform(split.where("part = 'dev'"))
    return out.select("id", F.chr(F.col("prediction").cast("int") + 97).alias("label"))


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of options named in four ways."""
    e = _raw(spark, d).select("row_id", F.posexplode("choice_labels").alias("pos", "label"))
    ways = [F.concat(F.lit("("), "label", F.lit(")")), F.concat(F.lit("Option_"), "label"), (F.col("pos") + 1).cast("string"), F.concat(F.lit("choice "), (F.col("pos") + 1).cast("string"))]
    return e.select("row_id", "pos", F.array_join(F.array(*[N.candidate_to_label(w, F.col("pos")) for w in ways]), ",").alias("labels"))


def index_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the numbers from 0 to the number of a row's characters."""
    n = _raw(spark, d).select("row_id", F.explode(F.sequence(F.lit(0), F.size("choice_labels") * 7)).alias("i"))
    return n.groupBy(N.label_from_index(F.col("i")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _as_text(c: str):
    """A list written as JSON, as a literal, or between commas, by the row."""
    literal = F.concat(F.lit("('"), F.array_join(c, "', '"), F.lit("',)"))
    return F.when(F.size(c) == 0, "").when(F.col("row_id") % 3 == 0, F.to_json(c)).when(F.col("row_id") % 3 == 1, literal).otherwise(F.array_join(c, " , "))


def parse_lists(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("row_id", F.array_join(N.parse_list(_as_text("choice_labels")), ",").alias("items"))


def gold_indices(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the right labels, written as text and read back."""
    at = F.transform("gold_letters", lambda g: F.array_position(F.transform("choice_labels", F.lower), F.lower(g)).cast("string"))
    return _raw(spark, d).select("row_id", F.array_join(N.gold_indices(F.concat(F.array_join(at, ", "), F.lit(", none"))), ",").alias("indices"))


def gold_generic(spark: SparkSession, d: str) -> DataFrame:
    """Right labels from the positions and the text of the first right option, whatever they say."""
    q = normalised(spark, d)
    at = F.transform("gold_letters", lambda g: F.array_position("choice_labels", g) - 1)
    letters = N.gold_generic(F.to_json(at), F.coalesce(F.try_element_at("option_texts", F.get("gold_letters", F.lit(0))), F.lit("")), F.col("choice_labels"), F.col("option_texts"))
    return q.select("id", F.array_join(F.array_sort(letters), ",").alias("letters"))


def _mixed(df: DataFrame, options) -> DataFrame:
    x = df.select("row_id", options.alias("_o"))
    m = x.select("row_id", N.mixed_options(F.col("_o"), x.schema["_o"].dataType).alias("m"))
    return m.select("row_id", F.posexplode("m.labels").alias("pos", "label"), "m.texts").select("row_id", "pos", "label", F.try_element_at("texts", F.col("label")).alias("option_text"))


def options_from_map(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(_raw(spark, d), F.col("option_texts"))


def options_from_list(spark: SparkSession, d: str) -> DataFrame:
    """Options as a list of texts that begin with their letter."""
    return _mixed(_raw(spark, d), F.transform(F.map_entries("option_texts"), lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))))


def options_from_maps(spark: SparkSession, d: str) -> DataFrame:
    """Options as a list of maps with a key and a text."""
    return _mixed(_raw(spark, d), F.transform(F.map_entries("option_texts"), lambda e: F.create_map(F.lit("Key"), e["key"], F.lit("Option_Text"), e["value"])))


def options_with_query(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the query's block and of the options, the block's first in order."""
    q = _raw(spark, d)
    m = N.mixed_options(F.col("option_texts"), q.schema["option_texts"].dataType, F.col("query_text"))
    return q.select("row_id", F.array_join(F.array_sort(m["labels"]), ",").alias("labels"), F.size(m["texts"]).alias("n"))


def options_by_label(spark: SparkSession, d: str) -> DataFrame:
    m = normalised(spark, d).select("id", N.options_by_label(F.col("choice_labels"), F.col("option_texts")).alias("m"))
    return m.select("id", F.explode("m").alias("label", "option_text"))


def wide_options(spark: SparkSession, d: str) -> DataFrame:
    """Options in a column each, brought back into one map."""
    known = {k: F.coalesce(F.try_element_at("option_texts", F.lit(k)), F.try_element_at("option_texts", F.lit(k.upper()))) for k in "abcdef"}
    return _raw(spark, d).select("row_id", F.explode(N.option_columns(known)).alias("label", "option_text"))


def item_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "heldout_items").where(N.matches_question_type(F.col("item_kind"), "MCQ")).select("item_id")


def english_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the English part, by their label where they have one and else by their id."""
    return table(spark, d, "documents").where(N.english_only(F.col("language"), F.col("id"))).select("doc_id")


def with_options(spark: SparkSession, d: str) -> DataFrame:
    """Questions that have options at all."""
    return normalised(spark, d).where(F.size("choice_labels") > 0).select("id", F.size("choice_labels").alias("n"))


def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    q = normalised(spark, d)
    return q.select("id", F.md5(N.answer_prompt(F.col("question"), F.col("choice_labels"), F.col("option_texts"))).alias("prompt"))


def predicted_letters(spark: SparkSession, d: str) -> DataFrame:
    """The first label that stands alone in the text of a question."""
    return normalised(spark, d).select("id", F.get(N.predicted_letter(F.col("question"), F.col("choice_labels")), F.lit(0)).alias("letter")).where("letter is not null")


def loss_masks(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the labels behind the codes of the id, the latter masked out."""
    q = normalised(spark, d)
    codes = F.concat(F.transform(F.split("id", ""), F.ascii), F.transform("choice_labels", F.ascii))
    return q.select("id", F.array_join(N.masked_labels(codes, F.length("id")), ",").alias("ids"))


NORMALISERS = (
    candidate_labels, index_labels, parse_lists, gold_indices, gold_generic, options_from_map, options_from_list, options_from_maps, options_with_query, options_by_label, wide_options, item_kinds, english_rows, with_options,
    answer_prompts, predicted_letters, loss_masks,
)
QUERIES = {
    f.__name__: f
    for f in (
        question_rows, dedup_keep_first, union_dedup_sources, option_rows, parse_option_map, parse_choices, answer_letters, map_indices, answer_string, question_summary, filter_4d,
        labelled_by_source, lexical_overlap_predict, most_common_letter, qa_accuracy, stratified_split, exact_fraction_sample, submission, multiclass_4d, *NORMALISERS,
    )
} | {f"pair_{k}": _pair(k) for k in ("logreg", "svm", "mlp", "word2vec")}

_Q = """
q0 as (select row_id, coalesce(nullif(trim(id), ''), concat_ws('_', 'bbf_en', split_name, row_id)) as id, split_name, coalesce(dataset_source, 'unknown') as dataset_source,
       coalesce(nullif(regexp_replace(question, '^[\\s\\xA0]+|[\\s\\xA0]+$', '', 'g'), ''), query_text) as question,
       list_transform(choice_labels, lambda x: lower(x)) as choice_labels, option_texts, list_transform(gold_letters, lambda x: lower(x)) as gold_letters from questions),
nq as (select * from (select *, row_number() over (partition by id order by row_id) as n from q0) where n = 1),
op as (select id, row_id, question, gold_letters, unnest(choice_labels) as label, generate_subscripts(choice_labels, 1) - 1 as pos, option_texts from nq),
ot as (select id, row_id, question, gold_letters, label, pos, coalesce(option_texts[label], option_texts[upper(label)], '') as option_text from op)"""
_LEX = """
lw as (select id, label, pos, list_distinct(regexp_extract_all(lower(question), '[a-z]{2,}')) as q, list_distinct(regexp_extract_all(lower(option_text), '[a-z]{2,}')) as o from ot),
ls as (select *, case when len(o) > 0 then len(list_intersect(q, o)) / len(o) else 0.0 end as score from lw),
lex as (select id, arg_min(label, struct_pack(a := -score, b := pos)) as label from ls group by 1),
com as (select coalesce((select gold_letters[1] as g from nq where len(gold_letters) > 0 group by 1 order by count(*) desc, 1 limit 1), 'a') as letter)"""
_GOLD = "array_to_string(gold_letters, ',')"

_TRIM = "regexp_replace({0}, '^[\\s\\xA0]+|[\\s\\xA0]+$', '', 'g')"
_ENTRIES = f"""e as (select row_id, unnest(map_entries(option_texts)) as x, generate_subscripts(map_entries(option_texts), 1) - 1 as pos from questions),
    o as (select row_id, pos, lower(x.key) as label, coalesce(nullif({_TRIM.format("coalesce(x.value, '')")}, ''), 'Option ' || chr(cast(65 + pos as int))) as option_text from e)"""
_MIXED = f"with {_ENTRIES} select row_id, pos, label, option_text from o"

SQL = {
    "candidate_labels": "with e as (select row_id, unnest(choice_labels) as label, generate_subscripts(choice_labels, 1) - 1 as pos from questions) select row_id, pos, lower(label) || ',' || lower(label) || ',' || chr(cast(97 + pos as int)) || ',' || chr(cast(97 + pos as int)) as labels from e",
    "index_labels": "with n as (select unnest(range(0, len(choice_labels) * 7 + 1)) as i from questions) select case when i < 26 then chr(cast(97 + i as int)) else 'option_' || (i + 1) end as label, count(*) as n from n group by 1",
    "parse_lists": "select row_id, array_to_string(choice_labels, ',') as items from questions",
    "gold_indices": "select row_id, array_to_string(list_transform(gold_letters, lambda g: list_position(list_transform(choice_labels, lambda x: lower(x)), lower(g))), ',') as indices from questions",
    "gold_generic": f"""with {_Q}, a as (select id, choice_labels as l, len(choice_labels) as n, gold_letters as g, option_texts, coalesce(option_texts[gold_letters[1]], option_texts[upper(gold_letters[1])], '') as t from nq),
        i as (select *, list_transform(list_filter(list_transform(string_split(t, ','), lambda x: {_TRIM.format('x')}), lambda x: regexp_matches(x, '^[+-]?[0-9]+$')), lambda x: cast(x as bigint)) as ix from a),
        m as (select *, case when len(list_filter(ix, lambda k: k < 0 or k >= n)) = 0 then list_transform(ix, lambda k: l[k + 1]) when len(list_filter(ix, lambda k: k < 1 or k > n)) = 0 then list_transform(ix, lambda k: l[k])
              else list_transform(ix, lambda k: case when k between 0 and n - 1 then l[k + 1] when k between 1 and n then l[k] end) end as byi from i),
        f as (select id, list_filter(list_concat(list_concat(list_filter(g, lambda x: list_contains(l, x)), byi), regexp_extract_all(lower(t), '[a-z]')), lambda x: list_contains(l, x)) as f, option_texts, t from m)
        select id, array_to_string(list_sort(list_distinct(f)), ',') as letters from f""",
    "options_from_map": _MIXED,
    "options_from_list": f"""with {_ENTRIES} select row_id, pos, label, case when contains({_TRIM.format("x.key || '. ' || coalesce(x.value, '')")}, chr(10)) then {_TRIM.format("x.key || '. ' || coalesce(x.value, '')")} else option_text end as option_text from e join o using (row_id, pos)""",
    "options_from_maps": _MIXED,
    "options_with_query": f"""with {_ENTRIES}, l as (select row_id, unnest(string_split_regex(query_text, '\\r\\n|[\\n\\v\\f\\r]')) as line from questions), h as (select distinct row_id, lower(regexp_extract(line, '^\\s*([A-Za-z])[.):]\\s*(.*)$', 1)) as label from l),
        u as (select row_id, label from o union select row_id, label from h where label <> '')
        select row_id, coalesce(array_to_string(list_sort(list(label) filter (label is not null)), ','), '') as labels, count(label) as n from questions left join u using (row_id) group by 1""",
    "options_by_label": f"with {_Q} select id, label, coalesce(nullif({_TRIM.format('option_text')}, ''), 'Option ' || upper(label)) as option_text from ot",
    "wide_options": f"with k as (select unnest(['a', 'b', 'c', 'd', 'e', 'f']) as label) select row_id, label, coalesce(option_texts[label], option_texts[upper(label)]) as option_text from questions, k where {_TRIM.format('coalesce(option_texts[label], option_texts[upper(label)])')} <> ''",
    "item_kinds": "select item_id from heldout_items where lower(trim(item_kind)) like '%mcq%' or lower(item_kind) like '%multiple choice%'",
    "english_rows": "select doc_id from documents where case when trim(coalesce(language, '')) <> '' then lower(trim(language)) = 'english' else coalesce(id, '') not like 'zh\\_%' escape '\\' end",
    "with_options": f"with {_Q} select id, len(choice_labels) as n from nq where len(choice_labels) > 0",
    "answer_prompts": f"""with {_Q} select id, md5('You are answering a financial multiple-choice question.' || chr(10) || 'Exactly one option is correct. Return only one option letter.' || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Options:' || chr(10)
        || array_to_string(list_transform(choice_labels, lambda k: upper(k) || '. ' || {_TRIM.format("coalesce(option_texts[k], option_texts[upper(k)], '')")}), chr(10)) || chr(10) || chr(10) || 'Answer:') as prompt from nq""",
    "predicted_letters": f"""with {_Q}, p as (select id, list_filter(list_transform(regexp_extract_all(question, '\\b([A-Za-z])\\b', 1), lambda x: lower(x)), lambda x: list_contains(choice_labels, x))[1] as letter from nq) select id, letter from p where letter is not null""",
    "loss_masks": f"with {_Q} select id, array_to_string(list_concat(list_transform(range(length(id)), lambda k: -100), list_transform(choice_labels, lambda x: ascii(x))), ',') as ids from nq",
    "question_rows": f"with {_Q} select row_id, id, dataset_source, array_to_string(choice_labels, ',') as labels, {_GOLD} as gold, length(question) as n_chars from nq",
    "dedup_keep_first": "select row_id, id, split_name from (select *, row_number() over (partition by id order by row_id) as n from questions) where n = 1",
    "union_dedup_sources": """select row_id, id, dataset_source from (select *, row_number() over (partition by id order by case dataset_source when 'finmmeval' then 0 else 1 end, row_id) as n
        from questions where dataset_source in ('finmmeval', 'bbf')) where n = 1""",
    "option_rows": f"with {_Q} select id, pos, label, option_text, 'Question: ' || question || chr(10) || 'Option ' || upper(label) || ': ' || option_text as feature_text, cast(list_contains(gold_letters, label) as int) as target from ot",
    "parse_option_map": r"""
        with l as (select row_id, unnest(string_split_regex(query_text, '\r\n|[\n\v\f\r\x{85}\x{2028}\x{2029}]')) as line, generate_subscripts(string_split_regex(query_text, '\r\n|[\n\v\f\r\x{85}\x{2028}\x{2029}]'), 1) as pos from questions where query_text is not null),
        h as (select *, regexp_extract(line, '^\s*([A-Za-z])[.):]\s*(.*)$', 1) as lab, regexp_extract(line, '^\s*([A-Za-z])[.):]\s*(.*)$', 2) as body from l),
        g as (select *, sum(cast(lab <> '' as int)) over (partition by row_id order by pos) as g from h),
        o as (select row_id, g, max(lower(lab)) as label, string_agg(case when lab <> '' then body else line end, ' ' order by pos) as v from g where g > 0 group by 1, 2),
        c as (select row_id, g, label, regexp_replace(regexp_replace(v, '[\s\x{A0}]+', ' ', 'g'), '^ | $', '', 'g') as v from o)
        select row_id, label, v as option_text from (select *, row_number() over (partition by row_id, label order by g desc) as n from c where v <> '') where n = 1""",
    "parse_choices": "select row_id, array_to_string(list_filter(list_transform(choice_labels, lambda x: lower(regexp_extract(x, '[A-Za-z]'))), lambda x: x <> ''), ',') as labels from questions",
    "answer_letters": "select row_id, array_to_string(list_transform(gold_letters, lambda x: lower(x)), ',') as letters from questions",
    "map_indices": f"with {_Q} select id, array_to_string(list_filter(gold_letters, lambda x: list_contains(choice_labels, x)), ',') as labels from nq",
    "answer_string": f"""with {_Q} select id, case when len(gold_letters) > 1 then '["' || array_to_string(gold_letters, '", "') || '"]' else coalesce(gold_letters[1], '') end as answer from nq""",
    "filter_4d": f"with {_Q} select id, gold_letters[1] as gold from nq where choice_labels = ['a', 'b', 'c', 'd'] and len(gold_letters) = 1 and gold_letters[1] in ('a', 'b', 'c', 'd')",
    "labelled_by_source": f"with {_Q} select dataset_source, count(*) as n, sum(cast(len(gold_letters) > 0 as int)) as labelled, sum(len(choice_labels)) as options from nq group by 1",
    "lexical_overlap_predict": f"with {_Q}, {_LEX} select id, label from lex",
    "most_common_letter": f"with {_Q}, {_LEX} select letter from com",
    "qa_accuracy": f"""with {_Q}, {_LEX}, p as (select 'lexical' as model, id, [label] as l from lex union all select 'common_letter', id, [letter] from nq, com)
        select model, count(*) as evaluated, round(avg(cast(gold_letters = l as double)), 6) as exact_match, round(avg(cast(gold_letters[1] = l[1] as double)), 6) as top1 from nq join p using (id) where len(gold_letters) > 0 group by 1""",
    "stratified_split": f"""with {_Q}, h as (select id, row_id, gold_letters[1] as s, {relational.order_hash_sql('row_id')} as h from nq where len(gold_letters) > 0)
        select id, case when row_number() over (partition by s order by h, row_id) <= round(count(*) over (partition by s) * 0.2) then 'dev' else 'train' end as part from h""",
    "exact_fraction_sample": f"""with {_Q} select id from (select id, row_number() over (order by {relational.order_hash_sql('row_id')}, row_id) as r, count(*) over () as n from nq) where r <= greatest(1, floor(n * 0.1))""",
    "submission": f"with {_Q}, {_LEX} select id, coalesce(label, '') as answer from nq left join lex using (id)",
    "question_summary": f"""with {_Q}, s as (select id, string_split(regexp_replace(regexp_replace(regexp_replace(question, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g'), '\\s+', ' ', 'g'), '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)) as p from nq)
        select id, array_to_string(p[1:2], ' ') as summary from s""",
}
