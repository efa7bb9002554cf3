"""Every registered query of the core, each over its whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import arrays as A
from tessella.functions import options as O
from tessella.functions import prompts as P
from tessella.functions import text as X
from tessella.operators import joins, judge, masks, metrics, monitoring, ranking, scorer, serving
from tessella.plans import ordinals
from tessella.plans.cut import Scratch
from tessella.sources import readers
from tessella.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# SQL pieces

_WS = X.SPACE
_EDGE = X.EDGE.replace("'", "''")


def _t(x: str) -> str:
    return f"coalesce({x}, '')"


def _strip(x: str) -> str:
    return f"regexp_replace({_t(x)}, '^{_WS}+|{_WS}+$', '', 'g')"


def _squash(x: str) -> str:
    return f"regexp_replace(regexp_replace({_t(x)}, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g')"


def _norm(x: str) -> str:
    b = f"trim({_squash(f'lower({_t(x)})')}, '{_EDGE}')"
    return f"(CASE WHEN {b} IN ('yes','y','true') THEN 'yes' WHEN {b} IN ('no','n','false') THEN 'no' ELSE {b} END)"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _ratio(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), 6)"


_OVERLAP = "coalesce(list_sum(list_transform(list_distinct(pw), lambda v: least(len(list_filter(pw, lambda y: y = v)), len(list_filter(gw, lambda y: y = v))))), 0)"
_GT = "gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY loaded_at DESC, rec_id DESC) AS rn FROM qa_record WHERE qid IS NOT NULL AND qid <> 0) WHERE rn = 1)"
_FACTS = f"""WITH {_GT},
facts AS (SELECT p.pred_id, p.qid, p.answer_type, p.extracted_pred AS pred, g.answer AS gold, g.question, g.modality, g.location, g.q_lang, g.content_type, g.base_type,
  p.route, p.chosen_variant, p.best_score, p.second_score, p.margin, p.invalid_image, p.raw_generation FROM prediction p JOIN gt g ON p.qid = g.qid),
normed AS (SELECT *, {_norm('pred')} AS np, {_norm('gold')} AS ng, upper({_t('answer_type')}) AS at_up FROM facts),
worded AS (SELECT *, {_words('np')} AS pw, {_words('ng')} AS gw FROM normed),
scored AS (SELECT *, np = ng AS ok, at_up = 'OPEN' AS is_open, CASE WHEN len(pw) = 0 OR len(gw) = 0 OR {_OVERLAP} = 0 THEN 0.0 ELSE 2.0 * {_OVERLAP} / (len(pw) + len(gw)) END AS f1 FROM worded)
"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the last record of their question."""
    gold = table(spark, d, "qa_record").filter("qid is not null and qid <> 0")
    cols = ["answer", "question", "modality", "location", "q_lang", "content_type", "base_type"]
    p = table(spark, d, "prediction").select("pred_id", "qid", "answer_type", F.col("extracted_pred").alias("pred"), "route", "chosen_variant", "best_score", "second_score", "margin", "invalid_image", "raw_generation")
    return joins.probe_join(p, gold, "qid", ["loaded_at", "rec_id"], cols).withColumnRenamed("answer", "gold")


# 1 scans, filters, coercion


@register(f"SELECT rec_id, qid, question FROM qa_record WHERE coalesce(q_lang, 'en') = 'en' ORDER BY qid, rec_id")
def load_filter_sort(spark, d):
    return readers.coerce(table(spark, d, "qa_record")).filter("q_lang = 'en'").select("rec_id", F.col("qid"), "question").orderBy("qid", "rec_id")


@register("SELECT rec_id, coalesce(qid, 0) AS qid, coalesce(img_id, 0) AS img_id, coalesce(img_name, '') AS img_name, coalesce(location, '') AS location, coalesce(modality, '') AS modality, coalesce(content_type, '') AS content_type, coalesce(q_lang, 'en') AS q_lang, coalesce(len(triple), 0) AS n_triples FROM qa_record")
def coerce_defaults(spark, d):
    return readers.coerce(table(spark, d, "qa_record")).select("rec_id", "qid", "img_id", "img_name", "location", "modality", "content_type", "q_lang", F.size("triple").alias("n_triples"))


@register("SELECT rec_id, concat_ws('/', '/data', 'img', img_name) AS image_path FROM qa_record")
def image_paths(spark, d):
    return table(spark, d, "qa_record").select("rec_id", readers.image_path("/data", F.col("img_name")).alias("image_path"))


@register("SELECT pred_id, upper(answer_type) AS key, CASE WHEN upper(answer_type) = 'OPEN' THEN 'OPEN' ELSE 'CLOSED' END AS path FROM prediction")
def answer_path(spark, d):
    up = F.upper("answer_type")
    return table(spark, d, "prediction").select("pred_id", up.alias("key"), F.when(up == "OPEN", "OPEN").otherwise("CLOSED").alias("path"))


@register("SELECT coalesce(nullif(lower(split), ''), 'train') AS split, count(*) AS n FROM qa_record WHERE coalesce(lower(split), 'train') IN ('', 'train') GROUP BY 1")
def train_split(spark, d):
    s = F.coalesce(F.lower("split"), F.lit("train"))
    return table(spark, d, "qa_record").filter(s.isin("", "train")).groupBy(F.coalesce(F.nullif(s, F.lit("")), F.lit("train")).alias("split")).agg(F.count("*").alias("n"))


@register("WITH lines AS (SELECT class_id AS pos, CASE WHEN class_id % 5 = 0 THEN label WHEN class_id % 7 = 0 THEN 'x' || class_id || ':' || label ELSE ' ' || (class_id // 2) || ' : ' || label END AS value FROM mask_label), p AS (SELECT try_cast(trim(split_part(value, ':', 1)) AS INTEGER) AS class_id, trim(substr(value, instr(value, ':') + 1)) AS label, pos, instr(value, ':') AS c FROM lines) SELECT class_id, arg_max(label, pos) AS label FROM p WHERE class_id IS NOT NULL AND c > 0 GROUP BY class_id")
def id_label_lines(spark, d):
    m = table(spark, d, "mask_label")
    line = F.when(F.col("class_id") % 5 == 0, F.col("label")).when(F.col("class_id") % 7 == 0, F.concat(F.lit("x"), F.col("class_id"), F.lit(":"), F.col("label"))).otherwise(F.concat(F.lit(" "), F.floor(F.col("class_id") / 2), F.lit(" : "), F.col("label")))
    return readers.parse_id_labels(m.select(line.alias("value"), F.col("class_id").alias("at")))


@register("SELECT raw_id, CAST(json_extract_string(payload, '$.img_id') AS BIGINT) AS img_id, json_extract_string(payload, '$.question') AS question, json_extract_string(payload, '$.answer_type') AS answer_type, json_array_length(payload, '$.triple') AS fields FROM raw_record")
def payload_records(spark, d):
    j = F.from_json("payload", "img_id bigint, question string, answer_type string, triple string")
    return table(spark, d, "raw_record").select("raw_id", j.alias("j")).select("raw_id", "j.img_id", "j.question", "j.answer_type", F.json_array_length("j.triple").cast("bigint").alias("fields"))


# 2 text core


@register(f"SELECT rec_id, {_norm('answer')} AS normalized FROM qa_record")
def normalize_answers(spark, d):
    return table(spark, d, "qa_record").select("rec_id", X.normalize_answer(F.col("answer")).alias("normalized"))


_AFTER = f"regexp_replace({_strip('raw_generation')}, '(?is)^.*?answer:', '')"
_LINES = f"list_filter(list_transform(regexp_split_to_array({_AFTER}, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda v: {_strip('v')}), lambda v: v <> '')"
_FIRST = f"coalesce({_LINES}[1], '')"


@register(f"SELECT pred_id, {_FIRST} AS line FROM prediction")
def first_nonempty_line(spark, d):
    return table(spark, d, "prediction").select("pred_id", X.first_non_empty_line(F.col("raw_generation")).alias("line"))


@register(f"WITH a AS (SELECT pred_id, {_FIRST} AS line FROM prediction) SELECT pred_id, {_norm('line')} AS short FROM a")
def short_answer(spark, d):
    return table(spark, d, "prediction").select("pred_id", X.short_answer(F.col("raw_generation")).alias("short"))


@register(f"{_FACTS} SELECT pred_id, round(f1, 6) AS f1, ok FROM scored")
def token_f1(spark, d):
    return metrics.scored(facts(spark, d)).select("pred_id", F.round("f1", 6).alias("f1"), "ok")


@register(f"SELECT doc_id, regexp_matches(lower({_strip('text')}), '^image{_WS}*[0-9]+$') AS is_index FROM documents")
def image_index_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_image_index(F.col("text")).alias("is_index"))


@register("SELECT doc_id, CASE WHEN length(coalesce(text,'')) > 400 THEN substr(text, 1, 397) || '...' ELSE coalesce(text,'') END AS short FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate(F.col("text")).alias("short"))


@register(f"SELECT rec_id, len(list_filter(list_transform(string_split({_t('answer')}, ','), lambda v: {_strip('v')}), lambda v: v <> '')) AS items FROM qa_record")
def csv_list_parse(spark, d):
    return table(spark, d, "qa_record").select("rec_id", F.size(X.csv_list(F.col("answer"))).cast("bigint").alias("items"))


@register(f"SELECT rec_id, CASE WHEN {_norm('answer')} IN ('yes','no') THEN {_norm('answer')} END AS yes_no, CASE {_norm('answer')} WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE {_strip('answer')} END AS titled FROM qa_record")
def yes_no_forms(spark, d):
    return table(spark, d, "qa_record").select("rec_id", X.yes_no(F.col("answer")).alias("yes_no"), X.title_yes_no(F.col("answer")).alias("titled"))


@register("SELECT content_type, CASE WHEN content_type = 'Abnormality' THEN 48 ELSE 16 END AS budget, count(*) AS n FROM qa_record GROUP BY 1, 2")
def token_budgets(spark, d):
    return table(spark, d, "qa_record").groupBy("content_type", X.max_new_tokens(F.col("content_type")).alias("budget")).agg(F.count("*").alias("n"))


@register("SELECT gen_settings_hash, md5(concat_ws(':', model, cast(n AS VARCHAR))) AS settings_key, n FROM (SELECT gen_settings_hash, coalesce(min(route), '') AS model, count(*) AS n FROM prediction GROUP BY 1)")
def settings_hash(spark, d):
    g = table(spark, d, "prediction").groupBy("gen_settings_hash").agg(F.coalesce(F.min("route"), F.lit("")).alias("model"), F.count("*").alias("n"))
    return g.select("gen_settings_hash", F.md5(F.concat_ws(":", "model", F.col("n").cast("string"))).alias("settings_key"), "n")


@register("SELECT DISTINCT model_name, split_part(model_name, '-', 1) AS family FROM generation_result")
def model_families(spark, d):
    return table(spark, d, "generation_result").select(X.model_name(F.concat(F.lit("/models/"), F.col("model_name"))).alias("model_name")).distinct().withColumn("family", F.split_part("model_name", F.lit("-"), F.lit(1)))


# 3 metrics


@register(f"{_FACTS} SELECT at_up AS key, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')} AS accuracy FROM scored GROUP BY 1")
def exact_match_by_type(spark, d):
    return metrics.exact_match(facts(spark, d), F.upper(X.text(F.col("answer_type"))))


_DIMS = " UNION ALL ".join(f"SELECT '{c}' AS dim, {_t(c)} AS value, ok, is_open, f1 FROM scored" for c in metrics.DIMENSIONS)


@register(f"{_FACTS}, long AS ({_DIMS}) SELECT dim, value, count(*) AS n, {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')} AS accuracy, count(*) FILTER (WHERE is_open) AS open_n, {_ratio('sum(f1) FILTER (WHERE is_open)', 'count(*) FILTER (WHERE is_open)')} AS open_f1 FROM long GROUP BY 1, 2")
def subgroup_metrics(spark, d):
    return metrics.subgroups(facts(spark, d))


@register(f"{_FACTS}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS okn, coalesce(CAST(count(*) FILTER (WHERE NOT is_open AND ok) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT is_open), 0), 0.0) AS c, coalesce(avg(f1) FILTER (WHERE is_open), 0.0) AS o FROM scored) SELECT n, {_ratio('okn', 'n')} AS accuracy, round(c, 6) AS closed_accuracy, round(o, 6) AS open_f1, round(0.5 * c + 0.5 * o, 6) AS overall_score FROM a")
def overall_score(spark, d):
    return metrics.overall(facts(spark, d))


@register(f"SELECT {_strip('lower(extracted_pred)')} AS value, count(*) AS n, min(pred_id) AS first_pos FROM prediction WHERE {_strip('extracted_pred')} <> '' GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 10")
def top_predictions(spark, d):
    return metrics.top_values(table(spark, d, "prediction"), X.strip(F.lower("extracted_pred")), "pred_id", 10)


_DCOLS = ["answer_type", "q_lang", "modality", "content_type", "base_type"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS dim, {_t(c)} AS value, count(*) AS n FROM qa_record GROUP BY 2" for c in _DCOLS))
def dataset_distribution(spark, d):
    return metrics.distribution(table(spark, d, "qa_record"), _DCOLS)


_GENERIC = ["liver", "image", "yes", "no", "lung"]
_GSQL = ",".join(f"'{g}'" for g in _GENERIC)


@register(f"{_FACTS} SELECT count(*) AS n, {_ratio('sum(f1)', 'count(*)')} AS mean_f1, {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')} AS exact_match, {_ratio(f'count(*) FILTER (WHERE np IN ({_GSQL}))', 'count(*)')} AS generic_rate, {_ratio('sum(len(' + _words(_squash('pred')) + '))', 'count(*)')} AS mean_pred_words, {_ratio('sum(length(' + _strip('pred') + '))', 'count(*)')} AS mean_pred_chars FROM scored WHERE is_open")
def open_summary(spark, d):
    return metrics.open_summary(facts(spark, d), _GENERIC)


@register(f"{_FACTS}, long AS (SELECT 'modality' AS dim, {_t('modality')} AS value, f1, np FROM scored WHERE is_open UNION ALL SELECT 'content_type', {_t('content_type')}, f1, np FROM scored WHERE is_open) SELECT dim, value, count(*) AS n, {_ratio(f'count(*) FILTER (WHERE np IN ({_GSQL}))', 'count(*)')} AS generic_rate, {_ratio('sum(f1)', 'count(*)')} AS token_f1 FROM long GROUP BY 1, 2")
def open_breakdown(spark, d):
    return metrics.open_breakdown(facts(spark, d), ["modality", "content_type"], _GENERIC)


@register(f"{_FACTS} SELECT at_up AS key, count(*) AS n, count(*) FILTER (WHERE coalesce(invalid_image, false)) AS invalid, {_ratio('count(*) FILTER (WHERE ok AND NOT coalesce(invalid_image, false))', 'count(*) FILTER (WHERE NOT coalesce(invalid_image, false))')} AS accuracy FROM scored GROUP BY 1")
def invalid_excluded_accuracy(spark, d):
    return metrics.invalid_excluded(facts(spark, d))


@register(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_strip('raw_generation')} = '') AS empty_raw, count(*) FILTER (WHERE {_strip('extracted_pred')} = '') AS empty_extracted, count(*) FILTER (WHERE regexp_matches(lower({_strip('extracted_pred')}), '^image{_WS}*[0-9]+$')) AS image_index, count(*) FILTER (WHERE coalesce(invalid_image, false)) AS invalid_images FROM prediction")
def run_counters(spark, d):
    return monitoring.run_counters(table(spark, d, "prediction"))


@register("SELECT route, count(*) AS n FROM prediction GROUP BY 1")
def predicted_routes(spark, d):
    return table(spark, d, "prediction").groupBy("route").agg(F.count("*").alias("n"))


@register(f"{_FACTS} SELECT route, count(*) AS n, {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')} AS accuracy, count(*) FILTER (WHERE np = 'yes') AS pred_yes, count(*) FILTER (WHERE np = 'no') AS pred_no, {_ratio(f'count(*) FILTER (WHERE best_score IS NOT NULL)', 'count(*)')} AS valid_ratio FROM scored WHERE route IS NOT NULL GROUP BY 1")
def route_accuracy(spark, d):
    s = metrics.scored(facts(spark, d)).filter("route is not null").withColumn("np", X.normalize_answer(F.col("pred")))
    return s.groupBy("route").agg(F.count("*").alias("n"), metrics.ratio(F.count_if("ok"), F.count("*")).alias("accuracy"), F.count_if(F.col("np") == "yes").alias("pred_yes"), F.count_if(F.col("np") == "no").alias("pred_no"), metrics.ratio(F.count("best_score"), F.count("*")).alias("valid_ratio"))


@register(f"{_FACTS} SELECT pred_id, np AS pred, ng AS gold FROM scored WHERE np <> ng AND ng IN ('yes','no') ORDER BY pred_id LIMIT 20")
def error_examples(spark, d):
    f = facts(spark, d).select("pred_id", X.normalize_answer(F.col("pred")).alias("pred"), X.normalize_answer(F.col("gold")).alias("gold"))
    return f.filter("pred <> gold and gold in ('yes','no')").orderBy("pred_id").limit(20)


# 4 routing


@register("SELECT rec_id, regexp_matches(coalesce(question,''), '(?i)(^|[^a-z0-9_À-ɏ一-鿿])(or|either|vs|versus)($|[^a-z0-9_À-ɏ一-鿿])|/') AS has_markers FROM qa_record")
def option_markers(spark, d):
    return table(spark, d, "qa_record").select("rec_id", O.has_option_markers(F.col("question")).alias("has_markers"))


_BAR = f"([-:.,;()\\[\\]]|{_WS})+"
_LEADS = "|".join(O.LEAD)
_STOPS = ",".join(f"'{w}'" for w in O.STOPWORDS)
_MEDS = "|".join(m for m in O.MEDICAL)
_NORMOPT = _norm("regexp_replace(" + _squash(f"regexp_replace(r, '^{_BAR}|{_BAR}$', '', 'g')") + f", '(?i)^(({_LEADS})( |$))+', '')")
_WORD = "[A-Za-z0-9][\\p{L}\\p{N}_/-]*"
_RUN = f"{_WORD}(?:{_WS}+{_WORD}){{0,9}}"


def _two(sep: str) -> str:
    return f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({_RUN}){_WS}+(?:{sep}){_WS}+({_RUN})(?:$|[^\\p{{L}}\\p{{N}}_])"


def _final(raws: str) -> str:
    """Finalized options of a list of raw ones, in order, each once."""
    n = f"list_transform(list_filter(list_transform({raws}, lambda r: {{'r': r, 'n': {_NORMOPT}}}), lambda p: length({_strip('p.n')}) > 1 AND len(list_filter({_words(_squash('lower(p.n)'))}, lambda k: k NOT IN ({_STOPS}))) > 0 AND (len({_words(_squash('p.n'))}) <= {O.WORD_LIMIT} OR regexp_matches(lower(p.r), '[0-9]|-|{_MEDS}'))), lambda p: p.n)"
    return n


def _once(name: str) -> str:
    return f"list_filter({name}, lambda v, i: list_position({name}, v) = i)"


_LABEL = O.LABEL
_LASTOR = "(length(q) - strpos(reverse(lower(q)), ' ro ') + 1)"
_OPTS = f"""WITH b AS (SELECT *, {_strip('question')} AS q FROM qa_record),
raws AS (SELECT *, CASE WHEN regexp_matches(q, '(?s){_LABEL}.*{_LABEL}') THEN list_filter(list_transform(string_split_regex(q, '{_LABEL}')[2:], lambda v: trim(v, ' ;:,.')), lambda v: v <> '') ELSE [] END AS r1,
  CASE WHEN contains(q, '/') THEN list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(q, '{_WS}*/{_WS}*', '/', 'g'), '[^/\\t-\\r\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+(?:/[^/\\t-\\r\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+)+'), lambda v: string_split(trim(regexp_replace(v, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'), ' ,;:?.'), '/'))), lambda v: v <> '') ELSE [] END AS r2,
  CASE WHEN regexp_matches(q, '(?i)\\s(vs|versus)\\s') AND regexp_matches(q, '{_two('vs|versus')}') THEN [regexp_extract(q, '{_two('vs|versus')}', 1), regexp_extract(q, '{_two('vs|versus')}', 2)] ELSE [] END AS r3,
  CASE WHEN regexp_matches(q, '(?i)\\sor\\s') AND regexp_matches(q, '{_two('or')}') THEN [regexp_extract(q, '{_two('or')}', 1), regexp_extract(q, '{_two('or')}', 2)] ELSE [] END AS r4,
  CASE WHEN contains(lower(q), ' or ') AND contains(q, ',') THEN list_concat(list_filter(list_transform(string_split(substr(q, 1, {_LASTOR} - 4), ','), lambda v: {_strip('v')}), lambda v: v <> ''), [trim(substr(q, {_LASTOR} + 1), ' ?;:.')]) ELSE [] END AS r5 FROM b),
fin AS (SELECT *, {_final('r1')} AS f1, {_final('r2')} AS f2, {_final('r3')} AS f3, {_final('r4')} AS f4, {_final('r5')} AS f5 FROM raws),
dist AS (SELECT *, {_once('f1')} AS o1, {_once('f2')} AS o2, {_once('f3')} AS o3, {_once('f4')} AS o4, {_once('f5')} AS o5 FROM fin),
opts AS (SELECT rec_id, question, answer, answer_type, CASE WHEN len(o1) >= 2 THEN o1 WHEN len(o2) >= 2 THEN o2 WHEN len(o3) >= 2 THEN o3 WHEN len(o4) >= 2 THEN o4 WHEN len(o5) >= 2 THEN o5 ELSE [] END AS options FROM dist)
"""


@register(f"{_OPTS} SELECT rec_id, options FROM opts")
def parse_options(spark, d):
    return table(spark, d, "qa_record").select("rec_id", O.parse_options(F.col("question")).alias("options"))


_AUX_IN = ",".join(f"'{a}'" for a in [*O.AUX_DETECT, "what", "which"])
_CW = "[\\p{L}\\p{M}\\p{N}_"
_SLASHED = f"(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-Za-z0-9]{_CW}-]*(?:{_WS}*/{_WS}*[A-Za-z0-9]{_CW}-]*)+)"
_ITEM = f"[A-Za-z0-9]{_CW}/ -]*"
_LISTED = f"({_ITEM}(?:{_WS}*,{_WS}*{_ITEM})+{_WS}*\\b(?:or|and)\\b{_WS}*[A-Za-z0-9]{_CW}/ -]+)"
_EITHER = f"(?i)(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-Za-z0-9]{_CW}/ -]+){_WS}+or{_WS}+([A-Za-z0-9]{_CW}/ -]+)"
_CLEAN = lambda x: f"list_filter(list_transform({x}, lambda v: {_strip('v')}), lambda v: v <> '')"
_QO = f"""WITH b AS (SELECT rec_id, coalesce(question, '') AS q, {_strip('question')} AS sq FROM qa_record),
m AS (SELECT *, CASE WHEN regexp_matches(q, '{_SLASHED}') THEN regexp_extract(q, '{_SLASHED}', 1) END AS sl,
  CASE WHEN regexp_matches(q, '(?i),{_WS}*{_LISTED}') THEN regexp_extract(q, '(?i),{_WS}*{_LISTED}', 1) WHEN regexp_matches(sq, '(?i)^{_LISTED}') THEN regexp_extract(sq, '(?i)^{_LISTED}', 1) END AS bl,
  CASE WHEN regexp_matches(q, '{_EITHER}') THEN [{_strip(f"regexp_extract(q, '{_EITHER}', 1)")}, {_strip(f"regexp_extract(q, '{_EITHER}', 2)")}] END AS ab FROM b),
o AS (SELECT rec_id, CASE WHEN sl IS NOT NULL THEN {_CLEAN("string_split(sl, '/')")} WHEN bl IS NOT NULL THEN {_CLEAN(f"string_split_regex(bl, '(?i){_WS}*(?:,|\\bor\\b|\\band\\b){_WS}*')")}
  WHEN ab IS NOT NULL AND lower(coalesce({_words(_squash('ab[1]'))}[1], '')) NOT IN ({_AUX_IN}) THEN ab ELSE [] END AS options FROM m)
SELECT rec_id, CASE WHEN len(options) > 1 THEN options ELSE [] END AS options FROM o"""


@register(_QO)
def question_options(spark, d):
    return table(spark, d, "qa_record").select("rec_id", O.question_options(F.col("question")).alias("options"))


_ROUTE = f"CASE WHEN len(options) >= 2 THEN 'options' WHEN lower({_strip('answer')}) IN ('yes','no') OR (NOT regexp_matches(coalesce(question,''), '(?i)(^|[^a-z0-9_À-ɏ一-鿿])(or|either|vs|versus)($|[^a-z0-9_À-ɏ一-鿿])|/') AND lower(coalesce({_words(_squash('question'))}[1], '')) IN ({','.join(repr(a) for a in O.AUX)})) THEN 'yesno' ELSE 'vocab' END"


@register(f"{_OPTS} SELECT {_ROUTE} AS route, count(*) AS n FROM opts WHERE upper(answer_type) = 'CLOSED' GROUP BY 1")
def route_counts(spark, d):
    closed = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED").withColumn("o", O.parse_options(F.col("question")))
    return closed.groupBy(O.closed_route(F.col("question"), F.col("answer"), F.col("o")).alias("route")).agg(F.count("*").alias("n"))


_AUX = ",".join(f"'{a}'" for a in O.AUX_DETECT)


@register(f"SELECT rec_id, (upper(coalesce(answer_type,'')) = 'CLOSED' AND {_norm('answer')} IN ('yes','no')) OR lower(coalesce({_words(_squash('question'))}[1], '')) IN ({_AUX}) AS yes_no_question FROM qa_record")
def yes_no_question(spark, d):
    return table(spark, d, "qa_record").select("rec_id", O.is_yes_no_question(F.col("question"), F.col("answer_type"), F.col("answer")).alias("yes_no_question"))


def closed_vocabulary(spark: SparkSession, d: str, k: int = 200) -> DataFrame:
    r = table(spark, d, "qa_record").filter((F.upper("answer_type") == "CLOSED") & F.coalesce(F.lower("split"), F.lit("train")).isin("", "train"))
    return metrics.top_values(r.filter(~F.lower(X.strip(F.col("answer"))).isin("yes", "no")), X.strip(F.col("answer")), "rec_id", k)


@register(f"SELECT {_strip('answer')} AS value, count(*) AS n, min(rec_id) AS first_pos FROM qa_record WHERE upper(answer_type) = 'CLOSED' AND coalesce(lower(split), 'train') IN ('', 'train') AND lower({_strip('answer')}) NOT IN ('yes','no','') GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 200")
def closed_vocab_topk(spark, d):
    return closed_vocabulary(spark, d)


@register(f"SELECT {_norm('answer')} AS value, count(*) AS n, min(rec_id) AS first_pos FROM qa_record WHERE upper(answer_type) = 'CLOSED' AND {_norm('answer')} <> '' GROUP BY 1")
def closed_vocab_normalized(spark, d):
    r = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED").select(X.normalize_answer(F.col("answer")).alias("value"), "rec_id").filter("value <> ''")
    return r.groupBy("value").agg(F.count("*").alias("n"), F.min("rec_id").alias("first_pos"))


@register(f"{_OPTS}, c AS (SELECT {_norm('answer')} AS a, options FROM opts WHERE upper(answer_type) = 'CLOSED' AND len(options) >= 2) SELECT count(*) AS n, round(count(*) FILTER (WHERE list_contains(list_transform(options, lambda o: {_norm('o')}), a)) / CAST(greatest(1, count(*)) AS DOUBLE), 6) AS gold_rate FROM c")
def gold_in_candidates(spark, d):
    r = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED").select(O.parse_options(F.col("question")).alias("o"), "answer").filter("size(o) >= 2")
    return r.agg(F.count("*").alias("n"), F.round(F.count_if(O.option_target(F.col("o"), F.col("answer")) >= 0) / F.greatest(F.lit(1), F.count("*")), 6).alias("gold_rate"))


@register(f"{_OPTS}, v AS (SELECT count(*) AS n FROM (SELECT {_strip('answer')} AS value, count(*) AS k, min(rec_id) AS fp FROM qa_record WHERE upper(answer_type) = 'CLOSED' AND coalesce(lower(split), 'train') IN ('', 'train') AND lower({_strip('answer')}) NOT IN ('yes','no','') GROUP BY 1 ORDER BY k DESC, fp LIMIT 200)), c AS (SELECT rec_id, {_ROUTE} AS route, len(options) AS k FROM opts WHERE upper(answer_type) = 'CLOSED') SELECT rec_id, route, CASE route WHEN 'options' THEN k WHEN 'yesno' THEN 2 ELSE v.n END AS n_labels, CASE route WHEN 'options' THEN k WHEN 'yesno' THEN 2 ELSE v.n END AS n_bases FROM c, v")
def closed_candidates(spark, d):
    vocab = [r["value"] for r in closed_vocabulary(spark, d).collect()]  # at most the operator's 200 labels
    r = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED")
    c = r.withColumn("o", O.parse_options(F.col("question"))).select("rec_id", O.closed_candidates(F.col("question"), F.col("answer"), vocab, options=F.col("o")).alias("c"))
    return c.select("rec_id", "c.route", F.size("c.labels").alias("n_labels"), F.size("c.variants").alias("n_bases"))


@register("WITH b AS (SELECT canon_id, label, [label, lower(label), upper(substr(label,1,1)) || lower(substr(label,2))] AS f FROM canonical_answer) SELECT canon_id, len(list_distinct(list_concat(f, list_transform(f, lambda x: ' ' || x)))) * 4 AS n_variants FROM b")
def candidate_variants(spark, d):
    return table(spark, d, "canonical_answer").select("canon_id", F.size(O.candidate_variants(F.col("label"))).cast("bigint").alias("n_variants"))


# 5 ranking


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidate scores: both scores of each closed prediction."""
    return scorer.precomputed(table(spark, d, "prediction"))


_SC = "sc AS (SELECT pred_id, qid, chosen_variant AS candidate, 0 AS position, best_score AS s FROM prediction WHERE best_score IS NOT NULL UNION ALL SELECT pred_id, qid, '', 1, second_score FROM prediction WHERE best_score IS NOT NULL)"


@register(f"WITH {_SC}, r AS (SELECT qid, candidate, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pred_id * 2 + position) AS rn, lead(s) OVER (PARTITION BY qid ORDER BY s DESC, pred_id * 2 + position) AS nx FROM sc WHERE s IS NOT NULL) SELECT qid, candidate AS best_label, round(s, 6) AS best_score, round(coalesce(nx, s), 6) AS second_score, round(s - coalesce(nx, s), 6) AS margin FROM r WHERE rn = 1")
def best_second_margin(spark, d):
    s = _scores(spark, d).withColumn("pos", F.col("pred_id") * 2 + F.col("position"))
    return ranking.best_second(s, ["qid"], "candidate", "logprob_sum", "pos")


@register("WITH r AS (SELECT qid, chosen_variant, best_score, row_number() OVER (PARTITION BY qid ORDER BY best_score DESC, pred_id) AS rn FROM prediction WHERE best_score IS NOT NULL) SELECT qid, chosen_variant AS variant, round(best_score, 6) AS score FROM r WHERE rn = 1")
def variant_max_per_base(spark, d):
    return ranking.variant_max(table(spark, d, "prediction"), ["qid"], "chosen_variant", "best_score", "pred_id")


_VO = f"v AS (SELECT label AS answer, list_distinct({_words(_norm('label'))}) AS tokens FROM canonical_answer), q AS (SELECT DISTINCT question, list_distinct({_words(_norm('question'))}) AS tokens FROM qa_record WHERE question IS NOT NULL)"


@register(f"WITH {_VO}, h AS (SELECT question, answer, len(list_intersect(q.tokens, v.tokens)) AS overlap FROM q, v) SELECT question, answer, overlap, rank FROM (SELECT question, answer, overlap, row_number() OVER (PARTITION BY question ORDER BY overlap DESC, answer) AS rank FROM h) WHERE rank <= 3")
def vocab_overlap_topk(spark, d):
    v = table(spark, d, "canonical_answer").select(F.col("label").alias("answer"), X.words(X.normalize_answer(F.col("label"))).alias("tokens"))
    q = table(spark, d, "qa_record").filter("question is not null").select("question").distinct().withColumn("tokens", X.words(X.normalize_answer(F.col("question"))))
    return ranking.vocab_overlap(q, "question", "tokens", v, 3)


@register("SELECT source, rec_id, rn FROM (SELECT source, rec_id, row_number() OVER (PARTITION BY source ORDER BY rec_id) AS rn FROM qa_record) WHERE rn <= 4")
def first_n_per_group(spark, d):
    return ranking.first_n(table(spark, d, "qa_record").select("source", "rec_id"), ["source"], ["rec_id"], 4)


@register("WITH o AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS p, count(*) OVER () AS t FROM qa_record) SELECT CAST(p // CAST(ceil(t / 7.0) AS BIGINT) AS INTEGER) AS chunk, count(*) AS n, min(rec_id) AS lo, max(rec_id) AS hi FROM o GROUP BY 1")
def contiguous_chunks(spark, d):
    return ranking.chunks(table(spark, d, "qa_record").select("rec_id"), "rec_id", 7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"))


@register("WITH o AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS p, count(*) OVER () AS t FROM qa_record) SELECT p AS ordinal, rec_id FROM o WHERE p IN (0, t // 3, t // 2, t - 1)")
def representative_rows(spark, d):
    return ranking.representatives(table(spark, d, "qa_record").select("rec_id"), "rec_id").select("ordinal", "rec_id")


# 6 diagnostics


@register(f"{_FACTS} SELECT count(*) FILTER (WHERE ng='yes' AND np='yes') AS yes_yes, count(*) FILTER (WHERE ng='yes' AND np='no') AS yes_no, count(*) FILTER (WHERE ng='no' AND np='yes') AS no_yes, count(*) FILTER (WHERE ng='no' AND np='no') AS no_no, count(*) AS yesno_total FROM scored WHERE ng IN ('yes','no')")
def yesno_confusion(spark, d):
    return metrics.confusion(facts(spark, d))


@register(f"{_FACTS}, c AS (SELECT count(*) FILTER (WHERE ng='yes' AND np='yes') AS yy, count(*) FILTER (WHERE ng='yes' AND np='no') AS yn, count(*) FILTER (WHERE ng='no' AND np='yes') AS ny, count(*) FILTER (WHERE ng='no' AND np='no') AS nn FROM scored) SELECT round(yy / CAST(greatest(1, yy + yn) AS DOUBLE), 6) AS recall_yes, round(nn / CAST(greatest(1, nn + ny) AS DOUBLE), 6) AS recall_no FROM c")
def recall_per_class(spark, d):
    return metrics.recall(facts(spark, d))


@register("SELECT coalesce(route, '') AS key, count(margin) AS n, round(coalesce(avg(margin), 0.0), 6) AS mean, round(coalesce(median(margin), 0.0), 6) AS median, round(coalesce(quantile_cont(margin, 0.9), 0.0), 6) AS p90 FROM prediction GROUP BY 1")
def margin_stats(spark, d):
    return metrics.margin_stats(table(spark, d, "prediction"), X.text(F.col("route")))


@register(f"WITH s AS (SELECT {_norm('extracted_pred')} AS p, margin FROM prediction), c AS (SELECT count(*) FILTER (WHERE p='yes') AS y, count(*) FILTER (WHERE p='no') AS n, count(*) FILTER (WHERE p='yes' AND margin < 0.05) AS ty, count(*) FILTER (WHERE p='no' AND margin < 0.05) AS tn FROM s WHERE p IN ('yes','no') AND margin IS NOT NULL) SELECT CASE WHEN y >= n THEN 'yes' ELSE 'no' END AS majority, y + n AS rows, {_ratio('CASE WHEN y >= n THEN ty ELSE tn END', 'y + n')} AS tiny_majority_rate FROM c")
def tiny_margin_rate(spark, d):
    return metrics.tiny_margins(table(spark, d, "prediction").withColumnRenamed("extracted_pred", "pred"))


@register(f"WITH s AS (SELECT {_norm('extracted_pred')} AS key, coalesce(chosen_variant, '') AS variant, pred_id FROM prediction), g AS (SELECT key, variant, count(*) AS n, min(pred_id) AS fp FROM s WHERE key <> '' AND variant <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, fp) AS rn, sum(n) OVER (PARTITION BY key) AS alln FROM g) SELECT key, variant, n, {_ratio('n', 'alln')} AS share FROM r WHERE rn = 1")
def variant_winner(spark, d):
    return metrics.variant_winner(table(spark, d, "prediction").withColumnRenamed("extracted_pred", "pred"), "pred_id")


@register("SELECT count(*) AS n, round(coalesce(corr(length(chosen_variant), best_score), 0.0), 6) AS r FROM prediction WHERE chosen_variant IS NOT NULL AND best_score IS NOT NULL")
def length_score_corr(spark, d):
    return metrics.correlation(table(spark, d, "prediction"), F.length("chosen_variant"), F.col("best_score"))


_ARM = "list_contains(list_transform(coalesce(triple, []), lambda t: len(list_filter(t, lambda f: lower(trim(coalesce(f, ''))) NOT IN ('', '_', 'none', 'null', 'vhead'))) >= 2), true)"


@register(f"{_FACTS}, a AS (SELECT s.at_up AS key, s.ok, coalesce({_ARM}, false) AS arm FROM scored s JOIN gt ON s.qid = gt.qid), b AS (SELECT key, coalesce(CAST(count(*) FILTER (WHERE arm AND ok) AS DOUBLE) / nullif(count(*) FILTER (WHERE arm), 0), 0.0) AS w, coalesce(CAST(count(*) FILTER (WHERE NOT arm AND ok) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT arm), 0), 0.0) AS wo FROM a GROUP BY 1) SELECT key, round(w, 6) AS with_arm, round(wo, 6) AS without_arm, round(w - wo, 6) AS delta FROM b")
def ablation_delta(spark, d):
    gold = joins.latest(table(spark, d, "qa_record").filter("qid is not null and qid <> 0").select("qid", "loaded_at", "rec_id", "triple"), "qid", ["loaded_at", "rec_id"]).select("qid", "triple")
    f = facts(spark, d).join(gold, "qid")
    return metrics.ablation(f, F.coalesce(F.exists("triple", P.is_real), F.lit(False)), F.upper(X.text(F.col("answer_type"))))


# 7 joins


@register(f"WITH {_GT} SELECT p.pred_id, p.qid, g.rec_id FROM prediction p JOIN gt g ON p.qid = g.qid")
def probe_join(spark, d):
    gold = table(spark, d, "qa_record").filter("qid is not null and qid <> 0")
    return joins.probe_join(table(spark, d, "prediction").select("pred_id", "qid"), gold, "qid", ["loaded_at", "rec_id"], ["rec_id"])


@register("WITH a AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS pos FROM qa_record), b AS (SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS pos FROM raw_record) SELECT pos, rec_id, raw_id FROM a JOIN b USING (pos)")
def positional_join(spark, d):
    return joins.positional_join(table(spark, d, "qa_record").select("rec_id"), table(spark, d, "raw_record").select("raw_id"), "rec_id", "raw_id").select("pos", "rec_id", "raw_id")


@register("WITH r AS (SELECT qid, arg_max(normalized_generation, row(generated_at, gen_id)) AS norm FROM generation_result WHERE normalized_generation IS NOT NULL AND qid <> 0 GROUP BY qid) SELECT p.pred_id, coalesce(r.norm, p.normalized_pred) AS normalized_pred FROM prediction p LEFT JOIN r ON p.qid = r.qid")
def retry_patch(spark, d):
    g = table(spark, d, "generation_result").filter("normalized_generation is not null and qid <> 0")
    one = joins.latest(g.select("qid", "generated_at", "gen_id", F.col("normalized_generation").alias("normalized_pred")), "qid", ["generated_at", "gen_id"])
    return joins.patch(table(spark, d, "prediction").select("pred_id", "qid", "normalized_pred"), one, "qid", ["normalized_pred"]).select("pred_id", "normalized_pred")


#: A point in brackets, in any language and spacing; with the slice a question has three numbers.
_POINT = r"[(（]\s*[0-9]+\s*[,，;；]\s*[0-9]+\s*[)）]"
_PIX = f"""nums AS (SELECT img_id, answer, regexp_extract_all(question, '[0-9]+') AS m, regexp_extract_all(regexp_extract(question, '{_POINT}'), '[0-9]+') AS p, regexp_extract_all(regexp_replace(question, '{_POINT}', ' '), '[0-9]+') AS r FROM qa_record WHERE img_id IS NOT NULL AND regexp_matches(question, '{_POINT}')),
px AS (SELECT n.img_id AS img, CAST(r[1] AS INTEGER) AS slice, CAST(p[1] AS INTEGER) AS x, CAST(p[2] AS INTEGER) AS y, l.class_id FROM nums n JOIN mask_label l ON trim(lower(n.answer), ' .') = lower(l.label) WHERE len(m) = 3)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """A pixel relation from the records that name the tissue at a point of a slice, whatever the language of the question."""
    numbers = lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1))
    q = F.col("question")
    point, rest = numbers(F.regexp_extract(q, _POINT, 0)), numbers(F.regexp_replace(q, _POINT, " "))
    r = table(spark, d, "qa_record").filter(q.rlike(_POINT) & (F.size(numbers(q)) == 3) & F.col("img_id").isNotNull())
    r = r.select(F.col("img_id").alias("img"), F.get(rest, 0).cast("int").alias("slice"), F.get(point, 0).cast("int").alias("x"), F.get(point, 1).cast("int").alias("y"), F.btrim(F.lower("answer"), F.lit(" .")).alias("name"))
    lab = table(spark, d, "mask_label").select("class_id", F.lower("label").alias("name"))
    return r.join(F.broadcast(lab) if lab.count() < 10_000 else lab, "name").drop("name")


_DIS = " OR ".join(f"contains(lower(label), '{w}')" for w in masks.DISEASE_WORDS)


@register(f"SELECT class_id, label FROM mask_label WHERE {_DIS}")
def disease_classes(spark, d):
    return masks.disease_classes(table(spark, d, "mask_label")).select("class_id", "label")


@register(f"WITH {_PIX} SELECT class_id, count(*) AS n FROM px WHERE class_id IN (SELECT class_id FROM mask_label WHERE label LIKE '%Left%') GROUP BY 1")
def semi_join_class(spark, d):
    ids = table(spark, d, "mask_label").filter("label like '%Left%'").select("class_id")
    return pixels(spark, d).join(ids, "class_id", "left_semi").groupBy("class_id").agg(F.count("*").alias("n"))


@register(f"SELECT label FROM canonical_answer WHERE lower(label) NOT IN (SELECT {_norm('answer')} FROM qa_record)")
def anti_join_vocab(spark, d):
    gold = table(spark, d, "qa_record").select(X.normalize_answer(F.col("answer")).alias("k")).distinct()
    return table(spark, d, "canonical_answer").select("label", F.lower("label").alias("k")).join(gold, "k", "left_anti").select("label")


@register("WITH l AS (SELECT canon_id, [label] || coalesce(aliases, []) AS bases FROM canonical_answer), e AS (SELECT canon_id, generate_subscripts(bases, 1) - 1 AS base_pos, unnest(bases) AS base FROM l), v AS (SELECT canon_id, base_pos, base, unnest([base, lower(base), upper(base)]) AS variant FROM e) SELECT canon_id, min(base_pos) AS base_pos, variant FROM v GROUP BY canon_id, variant")
def owned_variants(spark, d):
    l = table(spark, d, "canonical_answer").select("canon_id", F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("bases"))
    return joins.owned_variants(l, "canon_id", "bases", F.array("base", F.lower("base"), F.upper("base"))).select("canon_id", F.col("base_pos").cast("bigint").alias("base_pos"), "variant")


# 8 triples and prompts

_MEAN = "lambda f: lower(trim(coalesce(f, ''))) NOT IN ('', '_', 'none', 'null', 'vhead')"
_TRI = f"array_to_string(list_transform(list_filter(coalesce(triple, []), lambda t: len(list_filter(t, {_MEAN})) >= 2), lambda t: '(' || array_to_string(list_transform(list_filter(t, {_MEAN}), lambda f: trim(f)), ', ') || ')'), '; ')"


@register(f"SELECT rec_id, {_TRI} AS triples FROM qa_record")
def format_triples(spark, d):
    return table(spark, d, "qa_record").select("rec_id", P.format_triples(F.col("triple")).alias("triples"))


@register(f"WITH a AS (SELECT *, CASE WHEN lower(coalesce(base_type, '')) = 'kvqa' THEN {_TRI} ELSE '' END AS ctx FROM qa_record) SELECT rec_id, CASE WHEN ctx = '' THEN 'Question: ' || {_strip('question')} ELSE 'Context triples: ' || ctx || chr(10) || 'Question: ' || {_strip('question')} END AS block FROM a")
def question_blocks(spark, d):
    return table(spark, d, "qa_record").select("rec_id", P.question_block(F.col("question"), P.triples_context(F.col("triple"), F.col("base_type"), "kvqa_real_only")).alias("block"))


@register(f"SELECT rec_id, CASE WHEN {_TRI} = '' THEN coalesce(question, '') ELSE 'Context triples: ' || {_TRI} || '. Question: ' || coalesce(question, '') END AS question FROM qa_record")
def context_questions(spark, d):
    return table(spark, d, "qa_record").select("rec_id", P.append_context(F.col("question"), F.col("triple")).alias("question"))


_OPEN = "\n".join(P.OPEN_LINES).replace("'", "''") + "\nQuestion: "


@register(f"SELECT rec_id, '{_OPEN}' || coalesce(question, '') AS prompt FROM qa_record WHERE upper(answer_type) = 'OPEN'")
def build_prompt(spark, d):
    return table(spark, d, "qa_record").filter(F.upper("answer_type") == "OPEN").select("rec_id", P.open_text(F.col("question")).alias("prompt"))


@register("SELECT rec_id, '[INST] <image>' || chr(10) || question || ' [/INST] ' || answer || ' </s>' AS prompt FROM qa_record WHERE question <> '' AND answer <> ''")
def render_template(spark, d):
    r = table(spark, d, "qa_record").filter("question <> '' and answer <> ''")
    return r.select("rec_id", P.build_prompt(F.col("question"), "mistral_instruct", F.col("answer")).alias("prompt"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _template_sql(name: str) -> str:
    """The prompt of question and answer in one template."""
    t = P.template(name)
    turns = [(_lit(x), i) for i, x in enumerate(t.opening)]
    turns += [("('<image>' || chr(10) || question)", len(turns)), ("answer", len(turns) + 1)]
    out = []
    for m, i in turns:
        role, given = t.roles[i % 2], f"({m}) IS NOT NULL AND ({m}) <> ''"
        first = i == 0
        if t.style in ("single", "mpt"):
            colon = ": " if t.style == "single" else ""
            out.append(f"CASE WHEN {given} THEN {_lit(role + colon)} || {m} || {_lit(t.sep)} ELSE {_lit(role + colon.strip())} END")
        elif t.style == "two":
            out.append(f"CASE WHEN {given} THEN {_lit(role + ': ')} || {_strip(m)} || {_lit(t.sep2 + ' ' if i % 2 else t.sep)} ELSE {_lit(role + ':')} END")
        elif t.style == "plain":
            out.append(f"CASE WHEN {given} THEN {m} || {_lit(t.sep2 if i % 2 else t.sep)} ELSE '' END")
        elif i % 2:
            out.append(f"CASE WHEN {given} THEN " + (f"' ' || {m} || {_lit(' ' + t.sep2)}" if t.style == "llama_2" else f"{m} || '</s>'") + " ELSE '' END")
        else:
            head = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.style == "llama_2" and t.system and first else ""
            body = f"{_lit(t.system + ' ')} || {_strip(m)}" if t.style == "mistral" and first else m
            out.append(f"CASE WHEN {given} THEN {_lit((t.sep if t.style == 'llama_2' else '') + '[INST] ' + head)} || {body} || ' [/INST]' ELSE '' END")
    start = t.system + t.sep if t.style in ("single", "mpt", "two") else t.system if t.style == "plain" else ""
    sql = _lit(start) + " || " + " || ".join(out)
    if t.style == "two":
        return _strip(sql)
    if t.style == "llama_2":
        return f"ltrim({sql}, {_lit(t.sep)})" if t.sep else f"regexp_replace({sql}, '^\\s+', '')"
    return sql


@register("SELECT rec_id, " + ", ".join(f"{_template_sql(n)} AS {n}" for n in P.TEMPLATES) + " FROM qa_record")
def render_all_templates(spark, d):
    r = table(spark, d, "qa_record")
    return r.select("rec_id", *[P.build_prompt(F.col("question"), n, F.col("answer")).alias(n) for n in P.TEMPLATES])


@register("SELECT qid AS id, coalesce('/data/img/' || img_name, '/data/img') AS image, '<image>' || chr(10) || coalesce(question, '') AS human, coalesce(answer, '') AS gpt FROM qa_record")
def sft_records(spark, d):
    c = P.sft_conversation(F.col("question"), F.col("answer"))
    return table(spark, d, "qa_record").select(F.col("qid").alias("id"), readers.image_path("/data", F.col("img_name")).alias("image"), c.alias("c")).select("id", "image", F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("gpt"))


@register("SELECT rec_id, (length(coalesce(question,'')) - length(replace(coalesce(question,''), '<image>', ''))) // 7 AS n_images, ('<image>' || chr(10) || coalesce(question,'')) LIKE '%<image>%' AS has_image FROM qa_record")
def image_token_check(spark, d):
    q = F.col("question")
    return table(spark, d, "qa_record").select("rec_id", P.image_tokens(q).cast("bigint").alias("n_images"), (P.image_tokens(P.with_image(X.text(q))) >= 1).alias("has_image"))


# 9 arrays

_CH = "list_transform(list_filter(string_split(coalesce(question,''), ''), lambda c: c <> ''), lambda c: ascii(c) % 100 + 2)"


@register(f"SELECT rec_id, least(length(coalesce(question,'')), 512) AS prompt_length, least(length(coalesce(answer,'')), 64) AS answer_length, length(coalesce(question,'')) > 512 AS prompt_truncated, length(coalesce(answer,'')) > 64 AS answer_truncated, -100 * least(length(coalesce(question,'')), 512) AS masked_sum FROM qa_record")
def label_mask(spark, d):
    m = A.label_mask(A.char_tokens(F.col("question")), A.char_tokens(F.col("answer")))
    x = table(spark, d, "qa_record").select("rec_id", m.alias("m"))
    masked = F.aggregate(F.slice("m.labels", 1, F.col("m.prompt_length")), F.lit(0), lambda s, v: s + v)
    return x.select("rec_id", "m.prompt_length", "m.answer_length", "m.prompt_truncated", "m.answer_truncated", masked.alias("masked_sum"))


@register("SELECT canon_id, greatest(24 - length(label), 0) AS padded, length(label) + greatest(24 - length(label), 0) AS width FROM canonical_answer")
def pad_batch(spark, d):
    ids = A.char_tokens(F.col("label"))
    to = F.lit(24)
    x = table(spark, d, "canonical_answer").select("canon_id", A.pad_right(ids, to, 0).alias("r"), A.attention_left(ids, to).alias("m"))
    return x.select("canon_id", F.aggregate("m", F.lit(0), lambda s, v: s + F.when(v == 0, 1).otherwise(0)).alias("padded"), F.size("r").alias("width"))


@register("SELECT doc_id, CAST(ceil(len(w) / 50.0) AS INTEGER) AS n_slices, coalesce(least(len(w), 60), 0) AS first_len FROM (SELECT doc_id, list_filter(string_split(coalesce(text,''), ' '), lambda v: v <> '') AS w FROM documents)")
def sliding_slices(spark, d):
    w = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda v: v != "")
    s = table(spark, d, "documents").select("doc_id", A.sliding_slices(w, 50).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_slices"), F.coalesce(F.size(F.get("s", 0)), F.lit(0)).alias("first_len"))


@register("WITH o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY rec_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS t FROM qa_record) SELECT source, CAST(least(i // 100, greatest(0, ceil(t / 100.0 - 1.5))) AS INTEGER) AS chunk, count(*) AS n FROM o GROUP BY 1, 2")
def tail_merge_chunks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    o = table(spark, d, "qa_record").select("source", (F.row_number().over(w.orderBy("rec_id")) - 1).alias("i"), F.count("*").over(w).alias("t"))
    return o.groupBy("source", A.tail_chunk(F.col("i"), F.col("t"), 100).alias("chunk")).agg(F.count("*").alias("n"))


@register("SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS DOUBLE) AS total FROM embeddings")
def nested_sums(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(A.nested_sum(F.array(F.transform("embedding", lambda x: x.cast("double")))), 4).alias("total"))


# 10 sampling and batching


@register("WITH h AS (SELECT rec_id, answer_type, q_lang, md5('7:' || rec_id) AS h, md5(concat_ws(':', '7', coalesce(answer_type,''), coalesce(q_lang,''))) AS g FROM qa_record), r AS (SELECT *, row_number() OVER (PARTITION BY answer_type, q_lang ORDER BY h) AS rn FROM h) SELECT rec_id, answer_type, q_lang FROM r ORDER BY rn, g LIMIT 200")
def stratified_probe(spark, d):
    return ranking.stratified_probe(table(spark, d, "qa_record").select("rec_id", "answer_type", "q_lang"), ["answer_type", "q_lang"], F.col("rec_id"), 200, 7)


@register("WITH h AS (SELECT rec_id, upper(answer_type) = 'OPEN' AS o, md5('7:' || rec_id) AS h FROM qa_record), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY h) AS rn FROM h) SELECT rec_id, o AS is_open FROM r ORDER BY CASE WHEN rn > 25 THEN 1 ELSE 0 END, h LIMIT 50")
def balanced_sample(spark, d):
    r = table(spark, d, "qa_record").select("rec_id", (F.upper("answer_type") == "OPEN").alias("is_open"))
    return ranking.balanced_sample(r, F.col("is_open"), F.col("rec_id"), 50, 7)


_RB = "b AS (SELECT source, CAST(asked_at AS DATE) AS day, rec_id, coalesce(upper(answer_type) = 'OPEN', false) AS o, CASE WHEN content_type = 'Abnormality' THEN 48 ELSE 16 END AS bud FROM qa_record), l AS (SELECT *, lag(o) OVER w AS po, lag(CASE WHEN o THEN bud END) OVER w AS pb FROM b WINDOW w AS (PARTITION BY source, day ORDER BY rec_id)), n AS (SELECT *, CASE WHEN o AND (NOT coalesce(po, false) OR bud IS DISTINCT FROM pb) THEN 1 ELSE 0 END AS nw FROM l), r AS (SELECT *, sum(nw) OVER (PARTITION BY source, day ORDER BY rec_id ROWS UNBOUNDED PRECEDING) AS run FROM n), q AS (SELECT *, row_number() OVER (PARTITION BY source, day, run, o ORDER BY rec_id) AS k FROM r)"


@register(f"WITH {_RB} SELECT rec_id, CASE WHEN o THEN run END AS run_no, CASE WHEN o THEN (k - 1) // 4 END AS batch_in_run, CASE WHEN o THEN bud END AS budget FROM q")
def run_batches(spark, d):
    r = table(spark, d, "qa_record").select("rec_id", "source", F.to_date("asked_at").alias("day"), F.coalesce(F.upper("answer_type") == "OPEN", F.lit(False)).alias("o"), X.max_new_tokens(F.col("content_type")).alias("bud"))
    return ranking.run_batches(r, ["source", "day"], ["rec_id"], F.col("o"), F.col("bud"), 4).select("rec_id", "run_no", "batch_in_run", "budget")


@register("WITH v AS (SELECT item, row_number() OVER (ORDER BY md5(concat_ws(':', '7', item)), item) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT label AS item FROM canonical_answer)), q AS (SELECT rec_id, answer, CAST('0x' || substr(md5(concat_ws(':', '7', CAST(rec_id AS VARCHAR))), 1, 8) AS BIGINT) AS h FROM qa_record WHERE upper(answer_type) = 'CLOSED'), c AS (SELECT rec_id, item, row_number() OVER (PARTITION BY rec_id ORDER BY k) AS rank FROM q, (SELECT unnest([0, 1, 2, 3]) AS k) s, v WHERE v.pos = (h + k) % n AND item IS DISTINCT FROM answer) SELECT rec_id, item, rank FROM c WHERE rank <= 3")
def seeded_negatives(spark, d):
    q = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED").select("rec_id", "answer")
    return ranking.seeded_negatives(q, "rec_id", "answer", table(spark, d, "canonical_answer").select(F.col("label").alias("item")), 3, 7)


# 11 judge

_REV = f"{_FACTS}, rv AS (SELECT at_up AS kind, modality, CAST(1 + pred_id % 9 AS VARCHAR) || CASE WHEN pred_id % 11 = 0 THEN '' ELSE ' ' || CAST(1 + qid % 10 AS VARCHAR) END || chr(10) || 'because' AS review FROM scored), ps AS (SELECT kind, CASE WHEN modality = 'X-Ray' THEN 'chest_xray' WHEN modality = 'MRI' THEN 'mri' WHEN modality = 'CT' THEN 'ct_scan' END AS domain, string_split(string_split(review, chr(10))[1], ' ') AS s FROM rv), g AS (SELECT unnest([kind, 'overall', domain]) AS grp, CAST(s[1] AS DOUBLE) AS a, CAST(s[2] AS DOUBLE) AS b FROM ps WHERE len(s) = 2)"


@register(f"{_REV} SELECT grp, count(*) AS n, round(avg(a), 6) AS score1, round(avg(b), 6) AS score2, round(avg(b / a) * 100, 6) AS relative FROM g WHERE grp IS NOT NULL GROUP BY 1")
def judge_summary(spark, d):
    f = facts(spark, d)
    flags = F.struct((F.col("modality") == "X-Ray").alias("chest_xray"), (F.col("modality") == "MRI").alias("mri"), F.lit(False).alias("histology"), F.lit(False).alias("gross"), (F.col("modality") == "CT").alias("ct_scan"))
    second = F.when(F.col("pred_id") % 11 == 0, "").otherwise(F.concat(F.lit(" "), (1 + F.col("qid") % 10).cast("string")))
    r = f.select(F.upper(X.text(F.col("answer_type"))).alias("kind"), flags.alias("flags"), F.concat((1 + F.col("pred_id") % 9).cast("string"), second, F.lit("\nbecause")).alias("review"))
    return judge.summary(r.withColumn("domain", judge.first_domain(F.col("flags"))), "kind", "domain", "review")


@register("SELECT rec_id, '[Context]' || chr(10) || 'Figure Caption:' || chr(10) || coalesce(img_name,'') || ': ' || coalesce(location,'') || chr(10) || chr(10) || 'Figure Context:' || chr(10) || chr(9) || '- ' || coalesce(modality,'') || chr(10) || chr(10) || '[Question]' || chr(10) || coalesce(question,'') || chr(10) || chr(10) || '[Assistant 1]' || chr(10) || coalesce(answer,'') || chr(10) || chr(10) || '[End of Assistant 1]' || chr(10) || chr(10) || '[Assistant 2]' || chr(10) || coalesce(answer_type,'') || chr(10) || chr(10) || '[End of Assistant 2]' || chr(10) || chr(10) || '[System]' || chr(10) || 'Rate both.' || chr(10) || chr(10) AS prompt FROM qa_record")
def judge_prompt(spark, d):
    c = F.col
    return table(spark, d, "qa_record").select("rec_id", P.judge_prompt(c("img_name"), c("location"), c("modality"), c("question"), c("answer"), c("answer_type"), instruction="Rate both.").alias("prompt"))


# 12 masks


@register(f"WITH {_PIX}, u AS (SELECT DISTINCT img, slice, y, x FROM px WHERE class_id > 0), b AS (SELECT img, slice, count(*) AS n, min(x) AS a, min(y) AS b, max(x) + 1 AS c, max(y) + 1 AS d FROM u GROUP BY 1, 2) SELECT img, slice, n, greatest(0, a - CAST(trunc((c - a) * 0.25) AS INTEGER)) AS x0, greatest(0, b - CAST(trunc((d - b) * 0.25) AS INTEGER)) AS y0, least(512, c + CAST(trunc((c - a) * 0.25) AS INTEGER)) AS x1, least(512, d + CAST(trunc((d - b) * 0.25) AS INTEGER)) AS y1 FROM b")
def mask_union_bbox(spark, d):
    return masks.bounding_boxes(masks.union_mask(pixels(spark, d), ["img", "slice"]), ["img", "slice"], F.lit(512), F.lit(512))


@register("SELECT count(*) AS n, round(coalesce(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 0.0), 6) AS hit_rate FROM (SELECT coalesce(img_name <> '', false) AS hit FROM qa_record ORDER BY rec_id LIMIT 1000)")
def hit_rate(spark, d):
    return masks.hit_rate(table(spark, d, "qa_record"), "rec_id", F.coalesce(F.col("img_name") != "", F.lit(False)), 1000)


@register(f"WITH {_PIX}, s AS (SELECT img, slice, list_distinct(list(class_id)) AS v FROM px GROUP BY 1, 2) SELECT img, slice, CASE WHEN len(list_filter(v, lambda x: x NOT IN (0, 255))) = 0 THEN 'threshold' WHEN len(list_filter(v, lambda x: x NOT IN (0, 1))) = 0 THEN 'positive' ELSE 'nonzero' END AS rule FROM s")
def mask_rules(spark, d):
    s = pixels(spark, d).groupBy("img", "slice").agg(F.collect_set("class_id").alias("v"))
    return s.select("img", "slice", masks.mask_rule(F.col("v")).alias("rule"))


# 13 monitoring


@register("SELECT source, count(*) AS n, round(avg(length(coalesce(question,''))), 6) AS mean_len, max(length(coalesce(question,''))) AS max_len, sum(least(length(coalesce(question,'')), 64)) AS tokens, round(avg(CASE WHEN length(coalesce(question,'')) > 64 THEN 1.0 ELSE 0.0 END), 6) AS truncated, round(avg(CASE WHEN upper(answer_type) = 'OPEN' THEN 1.0 WHEN answer_type IS NULL THEN NULL ELSE 0.0 END), 6) AS open_ratio FROM qa_record GROUP BY 1")
def batch_stats(spark, d):
    return monitoring.batch_stats(table(spark, d, "qa_record"), ["source"], F.length(X.text(F.col("question"))), 64, F.upper("answer_type") == "OPEN")


@register("SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 21 ELSE CAST(floor(value / 25.0) AS INTEGER) + 1 END AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_fixed(spark, d):
    return monitoring.histogram(table(spark, d, "events"), "value", 0.0, 500.0, 20)


@register("WITH s AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, sum(value) AS amount FROM events GROUP BY 1, 2) SELECT event_type, slot, round(amount, 4) AS amount, round(amount / ((slot - lag(slot) OVER (PARTITION BY event_type ORDER BY slot)) * 3600), 6) AS per_second FROM s")
def throughput(spark, d):
    t = monitoring.throughput(table(spark, d, "events"), ["event_type"], F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000, F.col("value"), 3600)
    return t.select("event_type", "slot", F.round("amount", 4).alias("amount"), F.round("per_second", 6).alias("per_second"))


@register("SELECT split_part(p_type, ' ', 1) AS prefix, count(*) AS n, sum(p_size) AS total, sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END) AS trainable FROM part GROUP BY 1")
def param_tally(spark, d):
    p = table(spark, d, "part").select(F.translate("p_type", " ", ".").alias("name"), F.col("p_size").alias("numel"))
    return monitoring.parameter_tally(p, "name", "numel", F.col("numel") % 2 == 0)


@register("SELECT label, round(sqrt(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 3) AS norm FROM embeddings GROUP BY 1")
def l2_norms(spark, d):
    sq = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return monitoring.l2_norms(table(spark, d, "embeddings").select("label", sq.alias("v")), ["label"], "v").select("label", F.round("norm", 3).alias("norm"))


@register("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL")
def clean_scalars(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return monitoring.clean_scalars(e, "k")


# 14 serving


@register("SELECT user_id, max(ts) AS last_seen, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1")
def latest_worker_state(spark, d):
    return serving.latest_state(table(spark, d, "events"), "user_id", "ts", ["value"], "event_id").select("user_id", "last_seen", "value")


@register("WITH e AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT user_id, last_seen FROM e, m WHERE last_seen >= now - INTERVAL 86400 SECOND")
def heartbeat_ttl(spark, d):
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts").cast("string")).first()[0]).cast(e.schema["ts"].dataType)
    state = serving.latest_state(e, "user_id", "ts", ["value"], "event_id").select("user_id", "last_seen")
    return serving.alive(state, now, 86400).select("user_id", "last_seen")


@register("WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 21600 SECOND THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g) SELECT user_id, session_no, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS beats FROM s GROUP BY 1, 2")
def heartbeat_sessions(spark, d):
    return serving.sessions(table(spark, d, "events"), "user_id", "ts", 21600)


@register("WITH s AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS model, arg_max(value, row(ts, event_id)) AS q FROM events GROUP BY 1), l AS (SELECT model, user_id, q / (1 + user_id % 5) AS load FROM s) SELECT model, user_id, round(load, 6) AS load FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY load, user_id) AS rn FROM l) WHERE rn = 1")
def shortest_queue(spark, d):
    s = serving.latest_state(table(spark, d, "events").withColumnRenamed("event_type", "model"), "user_id", "ts", ["model", "value"], "event_id").withColumn("speed", 1 + F.col("user_id") % 5)
    return serving.shortest_queue(s, "model", "user_id", "value", "speed")


@register("SELECT count(DISTINCT event_type) AS models, sum(1 + user_id % 5) AS speed, round(sum(value), 2) AS queue_length FROM events")
def fleet_status(spark, d):
    e = table(spark, d, "events").withColumn("speed", 1 + F.col("user_id") % 5)
    return serving.fleet(e, "event_type", "value", "speed").select("models", "speed", F.round("queue_length", 2).alias("queue_length"))


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


# 15 scorer


@register(f"WITH {_SC} SELECT pred_id, position, round(s, 6) AS score FROM sc")
def precomputed_scorer(spark, d):
    return _scores(spark, d).select("pred_id", "position", F.round(O.length_normalized(F.col("logprob_sum"), F.col("n_tokens")), 6).alias("score"))


@register(f"{_OPTS}, c AS (SELECT rec_id AS qid, unnest(options) AS candidate, generate_subscripts(options, 1) - 1 AS position, list_distinct({_words(_squash('lower(question)'))}) AS known FROM opts WHERE upper(answer_type) = 'CLOSED' AND len(options) >= 2), w AS (SELECT *, {_words(_squash('lower(candidate)'))} AS cw FROM c) SELECT qid, candidate, position, round(ln((1 + len(list_filter(cw, lambda k: list_contains(known, k)))) / CAST(2 + len(cw) AS DOUBLE)), 5) AS logprob_sum, greatest(1, len(cw)) AS n_tokens FROM w")
def overlap_scorer(spark, d):
    r = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED").select("rec_id", "question").withColumn("c", O.parse_options(F.col("question"))).filter("size(c) >= 2")
    return scorer.apply_scorer(r.select(F.col("rec_id").alias("qid"), F.col("question").alias("prompt"), F.col("c").alias("candidates")), scorer.overlap_score).withColumn("logprob_sum", F.round("logprob_sum", 5))


# 16 further projections, checks and forms


@register(f"{_FACTS} SELECT count(*) AS n, count(*) FILTER (WHERE route = 'yesno' AND regexp_matches(coalesce(question,''), '(?i)(^|[^a-z0-9_À-ɏ一-鿿])(or|either|vs|versus)($|[^a-z0-9_À-ɏ一-鿿])|/')) AS misrouted FROM scored")
def misroute_count(spark, d):
    f = facts(spark, d)
    return f.agg(F.count("*").alias("n"), F.count_if((F.col("route") == "yesno") & O.has_option_markers(F.col("question"))).alias("misrouted"))


@register("SELECT model_name, CASE WHEN contains(coalesce(raw_generation,''), chr(10)) THEN 'stop_string' WHEN coalesce(raw_generation,'') LIKE '%.' THEN 'eos' ELSE 'max_new_tokens' END AS reason, count(*) AS n FROM generation_result GROUP BY 1, 2")
def stop_reasons(spark, d):
    g = X.text(F.col("raw_generation"))
    return table(spark, d, "generation_result").groupBy("model_name", X.stop_reason(g, F.lit("\n"), F.endswith(g, F.lit("."))).alias("reason")).agg(F.count("*").alias("n"))


@register("WITH b AS (SELECT rec_id, 100 + rec_id % 900 AS w, 80 + rec_id % 700 AS h FROM qa_record), r AS (SELECT *, greatest(w, h) / CAST(least(w, h) AS DOUBLE) AS asp FROM b), e AS (SELECT *, least(floor(800 / asp), 400, least(w, h)) AS sh FROM r), f AS (SELECT *, floor(sh * asp) AS lo FROM e) SELECT rec_id, CAST(CASE WHEN w >= h THEN lo ELSE sh END AS INTEGER) AS width, CAST(CASE WHEN w >= h THEN sh ELSE lo END AS INTEGER) AS height, greatest(w, h) AS side, CAST((greatest(w, h) - w) // 2 AS INTEGER) AS pad_left FROM f")
def image_sizes(spark, d):
    w, h = 100 + F.col("rec_id") % 900, 80 + F.col("rec_id") % 700
    x = table(spark, d, "qa_record").select("rec_id", A.aspect_size(w, h).alias("s"), A.square_padding(w, h).alias("p"))
    return x.select("rec_id", "s.width", "s.height", F.col("p.side").alias("side"), F.col("p.left").alias("pad_left"))


@register(f"WITH b AS (SELECT qid, max(best_score) FILTER (WHERE {_norm('chosen_variant')} = 'yes') AS y, max(best_score) FILTER (WHERE {_norm('chosen_variant')} = 'no') AS n FROM prediction WHERE best_score IS NOT NULL GROUP BY 1) SELECT qid, CASE WHEN y >= n THEN 'yes' ELSE 'no' END AS choice, round(abs(y - n), 6) AS margin FROM b WHERE y IS NOT NULL AND n IS NOT NULL")
def yes_no_choice(spark, d):
    v = X.normalize_answer(F.col("chosen_variant"))
    b = table(spark, d, "prediction").filter("best_score is not null").groupBy("qid").agg(F.max(F.when(v == "yes", F.col("best_score"))).alias("y"), F.max(F.when(v == "no", F.col("best_score"))).alias("n")).filter("y is not null and n is not null")
    return b.select("qid", F.when(F.col("y") >= F.col("n"), "yes").otherwise("no").alias("choice"), F.round(F.abs(F.col("y") - F.col("n")), 6).alias("margin"))


@register("SELECT rec_id, list_sort(list_distinct(list(model_name))) AS models FROM generation_result WHERE rec_id IS NOT NULL GROUP BY rec_id HAVING list_contains(list(model_name), 'probe-run')")
def model_membership(spark, d):
    g = table(spark, d, "generation_result").filter("rec_id is not null").groupBy("rec_id").agg(F.array_sort(F.collect_set("model_name")).alias("models"))
    return g.filter(F.array_contains("models", "probe-run"))


@register(f"WITH {_PIX}, a AS (SELECT DISTINCT img, slice, y, x, class_id % 7 AS v FROM px), b AS (SELECT img, slice + 1 AS slice, y, x, class_id % 5 AS v FROM px), ab AS (SELECT coalesce(a.img, b.img) AS img, coalesce(a.v, 0) AS va, coalesce(b.v, 0) AS vb FROM a FULL JOIN (SELECT DISTINCT img, slice - 1 AS slice, y, x, v FROM b) b USING (img, slice, y, x)) SELECT img, round(avg(abs(va - vb)), 6) AS diff FROM ab GROUP BY 1")
def pixel_diff(spark, d):
    px = pixels(spark, d)
    a, b = px.select("img", "slice", "y", "x", (F.col("class_id") % 7).alias("v")).distinct(), px.select("img", "slice", "y", "x", (F.col("class_id") % 5).alias("v")).distinct()
    return masks.pixel_difference(a, b, ["img"], on=["img", "slice", "y", "x"])


@register("SELECT canon_id, list_sort(list_distinct(list_transform(list_filter([label, lower(label), upper(label)], lambda v: v <> ''), lambda v: ascii(v) % 100 + 2))) AS first_ids FROM canonical_answer")
def banned_first_ids(spark, d):
    v = F.array("label", F.lower("label"), F.upper("label"))
    return table(spark, d, "canonical_answer").select("canon_id", A.banned_first_ids(v, A.char_tokens).alias("first_ids"))


@register("WITH p AS (SELECT rec_id, '<image>' || chr(10) || coalesce(question, '') AS t FROM qa_record), n AS (SELECT rec_id, t, (length(t) - length(replace(t, '<image>', ''))) // 7 AS k FROM p) SELECT rec_id, 1 + k + length(t) - 7 * k AS n_ids FROM n")
def image_prompt_ids(spark, d):
    return table(spark, d, "qa_record").select("rec_id", F.size(A.image_token_ids(P.with_image(X.text(F.col("question"))), A.char_tokens, 1)).alias("n_ids"))


@register("SELECT pred_id, round(best_score - (ln(exp(best_score - greatest(best_score, second_score)) + exp(second_score - greatest(best_score, second_score))) + greatest(best_score, second_score)), 6) AS logp_best FROM prediction WHERE best_score IS NOT NULL AND second_score IS NOT NULL")
def candidate_softmax(spark, d):
    p = table(spark, d, "prediction").filter("best_score is not null and second_score is not null")
    return p.select("pred_id", F.round(metrics.log_softmax(F.array("best_score", "second_score"))[0], 6).alias("logp_best"))


@register(f"{_REV} SELECT round(max(CASE WHEN grp = 'overall' THEN rel END), 6) AS overall, round(max(CASE WHEN grp = 'mri' THEN rel END), 6) AS mri, round(max(CASE WHEN grp = 'ct_scan' THEN rel END), 6) AS ct_scan FROM (SELECT grp, avg(b / a) * 100 AS rel FROM g WHERE grp IS NOT NULL GROUP BY 1)")
def judge_columns(spark, d):
    return judge_summary(spark, d).groupBy().pivot("grp", ["overall", "mri", "ct_scan"]).agg(F.max("relative"))


@register("SELECT strftime(generated_at, '%Y-%m-%d') || '-conv.json' AS file, count(*) AS n, round(min(epoch(generated_at)), 4) AS first_at FROM generation_result GROUP BY 1")
def log_files(spark, d):
    at = F.col("generated_at")
    return table(spark, d, "generation_result").groupBy(readers.log_path(at).alias("file")).agg(F.count("*").alias("n"), F.round(F.min(F.unix_micros(at.cast("timestamp")) / 1_000_000), 4).alias("first_at"))


@register("SELECT md5(payload) AS md5, count(*) AS n FROM raw_record WHERE payload IS NOT NULL GROUP BY 1")
def payload_store(spark, d):
    return table(spark, d, "raw_record").filter("payload is not null").groupBy(F.md5("payload").alias("md5")).agg(F.count("*").alias("n"))


@register("SELECT canon_id, 'label    : ' || label || chr(10) || 'category : ' || category AS lines FROM canonical_answer")
def key_value_tables(spark, d):
    return table(spark, d, "canonical_answer").select("canon_id", X.key_value_table(F.array(F.lit("label"), F.lit("category")), F.array("label", "category")).alias("lines"))


@register("SELECT rec_id, CASE WHEN upper(coalesce(answer_type, '')) <> 'OPEN' THEN 0 ELSE length(coalesce(answer, '')) END AS live_labels FROM qa_record")
def closed_labels_off(spark, d):
    ids = A.char_tokens(F.col("answer"))
    off = F.when(F.upper(X.text(F.col("answer_type"))) != "OPEN", F.transform(ids, lambda x: F.lit(A.IGNORE))).otherwise(ids)
    return table(spark, d, "qa_record").select("rec_id", F.size(F.filter(off, lambda x: x != A.IGNORE)).alias("live_labels"))


@register("SELECT source, bool_and(coalesce(question, '') NOT LIKE '%<image>%') AS all_single, count(*) AS n FROM qa_record GROUP BY 1")
def single_image_token(spark, d):
    one = P.image_tokens(P.with_image(X.text(F.col("question")))) == 1
    return table(spark, d, "qa_record").groupBy("source").agg(F.bool_and(one).alias("all_single"), F.count("*").alias("n"))


@register("SELECT p_partkey, (p_type LIKE '%PROMO' OR p_type LIKE '%ARGE') AS hit FROM part")
def target_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.name_matches(F.col("p_type"), "PROMO,ARGE").alias("hit"))


@register("SELECT count(*) AS n, round(avg(CASE WHEN img_name IS NULL THEN 0.0 ELSE 1.0 END), 6) AS named, avg(CASE WHEN img_name IS NULL THEN 0.0 ELSE 1.0 END) >= 0.9 AS passes FROM qa_record")
def image_gate(spark, d):
    share = F.avg(F.col("img_name").isNotNull().cast("int"))
    return table(spark, d, "qa_record").agg(F.count("*").alias("n"), F.round(share, 6).alias("named"), (share >= 0.9).alias("passes"))


@register("SELECT doc_id, contains(lower(coalesce(text,'')), 'nodule') OR contains(lower(coalesce(text,'')), 'cyst') AS matches FROM documents")
def error_classifier(spark, d):
    return table(spark, d, "documents").select("doc_id", X.error_matches(F.col("text"), ["nodule", "cyst"]).alias("matches"))


@register("SELECT img_name, min(p) AS pos FROM (SELECT DISTINCT img_name FROM documents WHERE img_name IS NOT NULL) w LEFT JOIN (SELECT DISTINCT img_name AS path, 0 AS p FROM qa_record) l ON w.img_name = l.path GROUP BY 1")
def resolved_paths(spark, d):
    want = table(spark, d, "documents").filter("img_name is not null").select("img_name").distinct().withColumn("c", F.array("img_name", F.concat(F.lit("/nowhere/"), F.col("img_name"))))
    got = masks.resolve_paths(want, table(spark, d, "qa_record").select(F.col("img_name").alias("path")).distinct(), "img_name", "c")
    return got.select("img_name", F.when(F.col("path").isNotNull(), 0).alias("pos"))


@register("SELECT img_id, img_name FROM (SELECT *, bool_or(regexp_matches(lower(img_name), 'view_2')) OVER (PARTITION BY img_id) AS anyd FROM (SELECT DISTINCT img_id, img_name FROM qa_record WHERE img_id > 0 AND img_name IS NOT NULL)) WHERE regexp_matches(lower(img_name), 'view_2') OR NOT anyd")
def preferred_masks(spark, d):
    m = table(spark, d, "qa_record").filter("img_id > 0 and img_name is not null").select("img_id", "img_name").distinct()
    return masks.preferred_masks(m.withColumn("_n", F.regexp_replace(F.lower("img_name"), "view_2", "lesion")), "img_id", "_n").select("img_id", "img_name")


@register("SELECT model_name, CASE WHEN contains(lower(model_name), 'vision') THEN CASE WHEN contains(lower(model_name), 'llama-2') THEN 'vision_llama_2' WHEN contains(lower(model_name), 'v1') THEN 'vision_v1' WHEN contains(lower(model_name), 'mpt') THEN 'mpt' ELSE 'vision_v0' END WHEN contains(lower(model_name), 'mpt') THEN 'mpt' WHEN contains(lower(model_name), 'llama-2') THEN 'llama_2' ELSE 'vicuna_v1' END AS template FROM (SELECT DISTINCT model_name FROM generation_result)")
def model_templates(spark, d):
    return table(spark, d, "generation_result").select("model_name").distinct().withColumn("template", X.template_name(F.col("model_name"), "vision"))


@register("SELECT CASE WHEN contains(p_type, 'PROMO') THEN 'vision' WHEN contains(p_type, 'ARGE') THEN 'language' ELSE 'other' END AS component, sum(p_size) AS total FROM part GROUP BY 1")
def component_sums(spark, d):
    c = monitoring.component_of(F.col("p_type"), [("PROMO", "vision"), ("ARGE", "language")])
    return table(spark, d, "part").groupBy(c.alias("component")).agg(F.sum("p_size").alias("total"))


@register("SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY 1")
def every_tenth_step(spark, d):
    return table(spark, d, "events").filter(monitoring.every(F.col("event_id"), 10)).groupBy("event_type").agg(F.count("*").alias("n"))


@register(f"SELECT rec_id, {_norm('answer')} AS normalized_gt, coalesce(answer, '') AS raw_gt FROM qa_record")
def gold_records(spark, d):
    return table(spark, d, "qa_record").select("rec_id", X.normalize_answer(F.col("answer")).alias("normalized_gt"), X.text(F.col("answer")).alias("raw_gt"))


@register("SELECT pred_id, qid, CASE WHEN upper(answer_type) = 'OPEN' THEN NULL ELSE route END AS route, CASE WHEN upper(answer_type) = 'OPEN' THEN NULL ELSE margin END AS margin FROM prediction")
def prediction_shapes(spark, d):
    p = table(spark, d, "prediction")
    up = F.upper("answer_type")
    return p.filter(up == "OPEN").select("pred_id", "qid").unionByName(p.filter(up != "OPEN").select("pred_id", "qid", "route", "margin"), allowMissingColumns=True)


@register("SELECT gen_id, CASE WHEN coalesce(raw_generation,'') LIKE '%.' THEN left(raw_generation, length(raw_generation) - 1) ELSE raw_generation END AS chunk FROM generation_result")
def trimmed_chunks(spark, d):
    from tessella.streaming.workers import stop_trimmed

    return table(spark, d, "generation_result").select("gen_id", stop_trimmed(F.col("raw_generation"), ".").alias("chunk"))


@register("SELECT label, format('{:,}', count(*) * 1000) AS shown FROM embeddings GROUP BY 1")
def formatted_counts(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(X.thousands(F.count("*") * 1000).alias("shown"))


@register("WITH t AS (SELECT img_id, '[INST] ' || question || ' [/INST] ' || answer || ' </s>' AS text, row_number() OVER (PARTITION BY img_id ORDER BY rec_id, question, answer) AS turn FROM qa_record WHERE img_id > 0 AND question <> '' AND answer <> '') SELECT img_id, (turn - 1) // 50 + 1 AS part, string_agg(text, '' ORDER BY turn) AS prompt FROM t GROUP BY 1, 2")
def conversation_prompts(spark, d):
    """Whole conversations of every image, in numbered parts of 50 turns, so that no row grows with an image's records."""
    t = conversation_turns(spark, d).select("img_id", "turn", (F.floor((F.col("turn") - 1) / 50) + 1).alias("part"), "prompt")
    m = t.groupBy("img_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "prompt"))).alias("m"))
    return m.select("img_id", "part", F.array_join(F.transform("m", lambda x: x["prompt"]), "").alias("prompt"))


@register("SELECT img_id, row_number() OVER (PARTITION BY img_id ORDER BY rec_id, question, answer) AS turn, rec_id, '[INST] ' || question || ' [/INST] ' || answer || ' </s>' AS prompt FROM qa_record WHERE img_id > 0 AND question <> '' AND answer <> ''")
def conversation_turns(spark, d):
    """Every turn of every image, a row each; in the order of turn they are the image's whole conversation."""
    r = table(spark, d, "qa_record").filter("img_id > 0 and question <> '' and answer <> ''").select("img_id", "rec_id", "question", "answer")
    t = ordinals.with_number_in(r, "img_id", "rec_id", "turn", ["question", "answer"])
    return t.select("img_id", "turn", "rec_id", P.render(F.array("question", "answer"), "mistral_instruct").alias("prompt"))


@register("WITH b AS (SELECT DISTINCT model_name AS name FROM generation_result), o AS (SELECT name, row_number() OVER (ORDER BY CASE WHEN name = 'probe-run' THEN 'aaa' ELSE name END, name) AS place FROM b) SELECT name, place FROM o")
def model_order(spark, d):
    from pyspark.sql import Window

    # a row per model
    key = F.when(F.col("name") == "probe-run", "aaa").otherwise(F.col("name"))
    return table(spark, d, "generation_result").select(F.col("model_name").alias("name")).distinct().withColumn("place", F.row_number().over(Window.orderBy(key, "name")))


@register("WITH w AS (SELECT user_id, count(*) AS weight FROM events GROUP BY 1), u AS (SELECT *, (CAST('0x' || substr(md5('7:' || user_id), 1, 8) AS BIGINT) + 1) / 4294967297.0 AS u FROM w) SELECT user_id, weight FROM u ORDER BY -ln(u) / weight LIMIT 1")
def lottery_worker(spark, d):
    return ranking.weighted_lottery(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("weight")), "weight", F.col("user_id"), 7)


@register("SELECT CASE WHEN v = 'Yes' THEN 'Yes' WHEN v = 'No' THEN 'No' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT CASE " + _norm("answer") + " WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE 'x' END AS v FROM qa_record WHERE upper(answer_type) = 'CLOSED') GROUP BY 1")
def sft_closed_answers(spark, d):
    v = X.title_yes_no(F.col("answer"))
    r = table(spark, d, "qa_record").filter(F.upper("answer_type") == "CLOSED")
    return r.groupBy(F.when(v == "Yes", "Yes").when(v == "No", "No").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


# 17 files written and read back, token sequences, counters


def _files(spark: SparkSession) -> str:
    return Scratch(spark, "files").path()


@register("SELECT rec_id, question, answer, modality FROM qa_record")
def jsonl_round_trip(spark, d):
    path = _files(spark)
    readers.write_jsonl(table(spark, d, "qa_record").select("rec_id", "question", "answer", "modality"), path)
    return readers.read_jsonl(spark, path, "rec_id bigint, question string, answer string, modality string")


@register("SELECT canon_id, label, category FROM canonical_answer")
def json_array_round_trip(spark, d):
    path = _files(spark)
    readers.write_json_array(table(spark, d, "canonical_answer").select("canon_id", "label", "category"), path, "canon_id")
    return spark.read.schema("canon_id bigint, label string, category string").option("multiLine", True).json(path)


@register("SELECT count(*) AS n, count(answer) AS answered FROM qa_record")
def document_round_trip(spark, d):
    path = _files(spark)
    readers.write_document(table(spark, d, "qa_record").agg(F.count("*").alias("n"), F.count("answer").alias("answered")), path)
    return spark.read.schema("n bigint, answered bigint").option("multiLine", True).json(path)


@register("SELECT canon_id, label, category FROM canonical_answer")
def csv_round_trip(spark, d):
    path = _files(spark)
    readers.write_csv(table(spark, d, "canonical_answer").select("canon_id", "label", "category"), path)
    return spark.read.schema("canon_id bigint, label string, category string").option("header", True).csv(path)


@register(f"SELECT row_number() OVER (ORDER BY n DESC, first_pos) AS rank, value AS answer, n FROM ({ORACLE['closed_vocab_topk']})")
def vocabulary_round_trip(spark, d):
    from pyspark.sql import Window

    path = _files(spark)
    # at most 200 rows
    readers.save_vocabulary(closed_vocabulary(spark, d).select(F.row_number().over(Window.orderBy(F.desc("n"), "first_pos")).alias("rank"), F.col("value").alias("answer"), "n"), path)
    return readers.load_vocabulary(spark, path)


@register("SELECT class_id, label FROM mask_label")
def id_label_file(spark, d):
    path = _files(spark)
    table(spark, d, "mask_label").select(F.concat_ws(":", F.col("class_id").cast("string"), "label")).union(spark.createDataFrame([("no colon",), ("x:no number",)], "value string")).write.text(path)
    return readers.read_id_labels(spark, path)


@register("SELECT canon_id AS qid, label AS question, category AS answer, 1 AS n_triples FROM canonical_answer")
def split_file(spark, d):
    path = _files(spark)
    c = table(spark, d, "canonical_answer").select(F.col("canon_id").alias("qid"), F.col("label").alias("question"), F.col("category").alias("answer"), F.array("category", F.lit("is"), "label").alias("triple"))
    readers.write_json_array(c, f"{path}/train.json", "qid")
    return readers.read_split(spark, path, "train").select("qid", "question", "answer", F.size("triple").alias("n_triples"))


@register("SELECT label AS organ, 'category' AS attribute, category AS value FROM canonical_answer")
def graph_edges(spark, d):
    path = _files(spark)
    table(spark, d, "canonical_answer").select(F.col("label").alias("organ"), F.lit("category").alias("attribute"), F.col("category").alias("value")).write.option("header", True).option("sep", "#").csv(path)
    return readers.read_edges(spark, path)


@register("SELECT label, CAST(class_id AS DOUBLE) AS x, CAST(class_id + 4 AS DOUBLE) AS y FROM mask_label")
def box_files(spark, d):
    path = _files(spark)
    box = F.create_map("label", F.array(F.col("class_id"), F.col("class_id") + 4, F.lit(7), F.lit(8)))
    table(spark, d, "mask_label").select(F.to_json(F.array(box))).coalesce(1).write.option("lineSep", "\n").text(path)
    lines = spark.read.text(path)
    # a file holds one array, so the lines are joined to one
    lines.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.expr("substring(value, 2, length(value) - 2)"))), ","), F.lit("]"))).coalesce(1).write.text(f"{path}-one")
    return readers.read_boxes(spark, f"{path}-one/*.txt").select("label", F.col("box")[0].alias("x"), F.col("box")[1].alias("y"))


@register("SELECT label AS question, category AS answer, 1 AS n_triples FROM canonical_answer")
def question_files(spark, d):
    path = _files(spark)
    c = table(spark, d, "canonical_answer").select(F.col("label").alias("question"), F.col("category").alias("answer"), F.to_json(F.array("category", F.lit("is"), "label")).alias("triple"), "canon_id")
    readers.write_json_array(c, path, "canon_id")
    return readers.read_question_files(spark, f"{path}/*.txt").select("question", "answer", F.size("triple").alias("n_triples"))


@register("SELECT doc_id, md5(text) AS md5 FROM documents")
def base64_round_trip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(readers.decode_image(F.base64(F.col("text").cast("binary")))).alias("md5"))


@register("SELECT g.gen_id, r.img_name FROM generation_result g JOIN qa_record r ON g.rec_id = r.rec_id")
def owner_gather(spark, d):
    return joins.gather(table(spark, d, "generation_result").select("gen_id", "rec_id"), table(spark, d, "qa_record"), "rec_id", ["img_name"]).select("gen_id", "img_name")


@register(f"SELECT doc_id, coalesce(regexp_split_to_array({_strip('text')}, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')[1], '') AS line FROM documents")
def first_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_line(F.col("text")).alias("line"))


_BARE = "regexp_replace(line, '(?i)^answer:', '')"


@register(f"WITH a AS (SELECT pred_id, {_FIRST} AS line FROM prediction) SELECT pred_id, {_strip(_BARE)} AS answer FROM a")
def answers_without_prefix(spark, d):
    return table(spark, d, "prediction").select("pred_id", X.strip_answer_prefix(F.col("raw_generation")).alias("answer"))


@register("SELECT user_id, event_type, count(value) AS n_tokens, round(coalesce(sum(-value), 0.0) / greatest(count(value), 1), 6) AS score FROM events GROUP BY 1, 2")
def token_probabilities(spark, d):
    return metrics.token_probability(table(spark, d, "events").select("user_id", "event_type", (-F.col("value")).alias("logprob")), ["user_id", "event_type"], "logprob")


@register("SELECT name, CASE WHEN style = 'two' THEN nullif(sep2, '') ELSE coalesce(nullif(sep, ''), nullif(sep2, '')) END AS stop FROM (VALUES " + ", ".join("(" + ", ".join(_lit(x) for x in (n, t.style, t.sep, t.sep2)) + ")" for n, t in P.TEMPLATES.items()) + ") t(name, style, sep, sep2)")
def stop_strings(spark, d):
    return spark.createDataFrame([(n, P.stop_string(n)) for n in P.TEMPLATES], "name string, stop string")


_LCH = "list_transform(list_filter(string_split(label, ''), lambda c: c <> ''), lambda c: ascii(c) % 100 + 2)"


@register(f"SELECT canon_id, list_concat(list_transform(range(greatest(24 - length(label), 0)), lambda i: 0), {_LCH}) AS ids, length(label) AS live, greatest(length(label) - 3, 0) AS generated FROM canonical_answer")
def left_padding(spark, d):
    ids, to = A.char_tokens(F.col("label")), F.lit(24)
    c = table(spark, d, "canonical_answer")
    return c.select("canon_id", A.pad_left(ids, to, 0).alias("ids"), F.aggregate(A.attention_left(ids, to), F.lit(0), lambda s, v: s + v).alias("live"), F.size(A.generated_suffix(ids, F.lit(3))).alias("generated"))


@register(f"SELECT rec_id, {_TRI} <> '' AS triple_context_used FROM qa_record")
def context_flags(spark, d):
    return table(spark, d, "qa_record").select("rec_id", (P.format_triples(F.col("triple")) != "").alias("triple_context_used"))


_RW = _words(_squash("raw_generation"))


@register(f"WITH w AS (SELECT {_RW} AS w FROM prediction), l AS (SELECT 'first' AS place, coalesce(w[1], '') AS token FROM w UNION ALL SELECT 'last', coalesce(w[len(w)], '') FROM w) SELECT place, token, count(*) AS n FROM l GROUP BY 1, 2")
def token_histogram(spark, d):
    return monitoring.token_histogram(table(spark, d, "prediction"), F.col("raw_generation"))


@register(f"SELECT coalesce(route, '') AS key, count(*) AS n, count(*) FILTER (WHERE {_strip('extracted_pred')} = '' AND NOT coalesce(invalid_image, false)) AS retries FROM prediction GROUP BY 1")
def retry_counts(spark, d):
    return monitoring.retries(table(spark, d, "prediction"), X.text(F.col("route")))


@register("SELECT route, count(*) AS n, round(coalesce(avg(-best_score), 0.0), 6) AS mean_loss, round(count(best_score) / CAST(count(*) AS DOUBLE), 6) AS valid_ratio FROM prediction WHERE route IS NOT NULL GROUP BY 1")
def route_losses(spark, d):
    return metrics.route_losses(table(spark, d, "prediction").filter("route is not null"), "route", "best_score")


@register(f"SELECT upper({_t('answer_type')}) AS key, count(*) AS n, round(avg(len({_RW})), 6) AS mean_words, count(*) FILTER (WHERE {_strip('raw_generation')} <> '') AS non_empty, count(*) FILTER (WHERE {_strip('raw_generation')} <> '') >= count(*) - 1 AS passes FROM prediction GROUP BY 1")
def generation_gate(spark, d):
    return metrics.generation_gate(table(spark, d, "prediction"), F.upper(X.text(F.col("answer_type"))), F.col("raw_generation"))


@register("SELECT event_type, count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS n, round(coalesce(avg(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 0.0), 6) AS mean FROM events GROUP BY 1")
def mean_of_texts(spark, d):
    return metrics.mean_of_texts(table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k")), ["event_type"], "k")


@register("SELECT count(*) AS n, count(*) AS n_ids FROM generation_result")
def answer_ids(spark, d):
    return table(spark, d, "generation_result").select(X.answer_id().alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


_PXD = "i AS (SELECT DISTINCT img, slice, y, x, class_id AS v FROM px), k AS (SELECT DISTINCT img, slice, y, x FROM px WHERE class_id % 2 = 0)"


@register(f"WITH {_PIX}, {_PXD} SELECT i.img, i.slice, i.y, i.x, CASE WHEN k.img IS NOT NULL OR NOT EXISTS (SELECT 1 FROM k AS o WHERE o.img = i.img AND o.slice = i.slice) THEN i.v ELSE 0 END AS v FROM i LEFT JOIN k USING (img, slice, y, x)")
def masked_images(spark, d):
    px = pixels(spark, d)
    image = px.select("img", "slice", "y", "x", F.col("class_id").alias("v")).distinct()
    return masks.apply_mask(image, px.filter("class_id % 2 = 0"), ["img", "slice"])


@register(f"WITH {_PIX}, {_PXD}, b AS (SELECT img, slice, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM k GROUP BY 1, 2) SELECT i.img, i.slice, i.y - coalesce(y0, 0) AS y, i.x - coalesce(x0, 0) AS x, i.v FROM i LEFT JOIN b USING (img, slice) WHERE x0 IS NULL OR (i.x >= x0 AND i.x < x1 AND i.y >= y0 AND i.y < y1)")
def cropped_images(spark, d):
    px = pixels(spark, d)
    image = px.select("img", "slice", "y", "x", F.col("class_id").alias("v")).distinct()
    boxes = px.filter("class_id % 2 = 0").groupBy("img", "slice").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return masks.crop(image, boxes, ["img", "slice"])


@register("WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1), p AS (SELECT user_id, arg_max(value, row(ts, event_id)) AS value FROM events WHERE event_type = 'click' GROUP BY 1) SELECT s.user_id, s.last_seen, p.value FROM s JOIN p USING (user_id)")
def refreshed_workers(spark, d):
    e = table(spark, d, "events")
    state = serving.latest_state(e, "user_id", "ts", ["value"], "event_id")
    polls = serving.latest_state(e.filter("event_type = 'click'"), "user_id", "ts", ["value"], "event_id").select("user_id", "value", F.lit(True).alias("ok"))
    return serving.refresh(state, polls, "user_id", "ok", ["value"]).select("user_id", "last_seen", "value")


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    """windowed_events as a stream over the files, run to its end."""
    from tessella.streaming import workers

    files = Scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = workers.windowed_counts(stream, "ts", "1 hour", None, "event_type", "value", "3650 days")
    out = files.path()

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    rows.writeStream.outputMode("complete").option("checkpointLocation", files.path()).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    got = spark.read.parquet(out)
    return got.select(F.col("start").cast(schema["ts"].dataType).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
