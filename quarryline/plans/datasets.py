"""Queries over texts and labels: normalising, deduplication, splits, metrics, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import answers, dataset, evaluation
from quarryline.plans.registry import query, table
from quarryline.sources import files
from quarryline.streaming import streams

#: White space as Python and Java (?U) know it, for RE2.
_WS = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = f"trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g'))"


def _quoted(p: str) -> str:
    return p.replace("'", "''")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, md5({_NORM}) AS norm_md5 FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.squeeze("text").cast("binary")).alias("norm_md5"))


@query("SELECT doc_id, translate(upper(trim(' ' || lang || '.' || source || '/x ')), './', '--') AS ticker FROM documents")
def ticker_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.normalize_ticker(F.concat(F.lit(" "), "lang", F.lit("."), "source", F.lit("/x "))).alias("ticker"))


_SENT = "(CASE e.event_id % 5 WHEN 0 THEN '$' || format('{:.2f}', e.value) || ' million' WHEN 1 THEN 'form 10-K of ' || e.user_id::VARCHAR WHEN 2 THEN e.user_id::VARCHAR || ',000 Thousand units' WHEN 3 THEN 'no number' ELSE e.user_id::VARCHAR || ' and 10-Q, 3 billion' END)"
_NUMS = r"""list_transform(list_filter(list_zip(regexp_extract_all(s, '(?i)(\d[\d,]*\.?\d*)(-[KQ])?(\s{0,11}(thousand|million|billion|trillion))?', 1), regexp_extract_all(s, '(?i)(\d[\d,]*\.?\d*)(-[KQ])?(\s{0,11}(thousand|million|billion|trillion))?', 2), regexp_extract_all(s, '(?i)(\d[\d,]*\.?\d*)(-[KQ])?(\s{0,11}(thousand|million|billion|trillion))?', 4)),
  lambda r: NOT (r[1] = '10' AND upper(coalesce(r[2], '')) IN ('-K', '-Q'))), lambda r: replace(r[1], ',', '')::DOUBLE * CASE lower(r[3]) WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'trillion' THEN 1e12 ELSE 1 END)"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 5
    s = F.when(kind == 0, F.concat(F.lit("$"), F.format_string("%.2f", "value"), F.lit(" million"))).when(kind == 1, F.concat(F.lit("form 10-K of "), user)).when(kind == 2, F.concat(user, F.lit(",000 Thousand units"))).when(kind == 3, F.lit("no number")).otherwise(F.concat(user, F.lit(" and 10-Q, 3 billion")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", s.alias("s"))


@query(f"WITH t AS (SELECT event_id, {_SENT} AS s FROM events e) SELECT event_id, array_to_string(list_transform({_NUMS}, lambda x: round(x, 2)::DECIMAL(28, 2)::VARCHAR), ';') AS numbers FROM t")
def numbers_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    nums = F.transform(X.extract_numbers("s"), lambda x: F.round(x, 2).cast("decimal(28,2)").cast("string"))
    return _sentences(spark, sf_dir).select("event_id", F.array_join(nums, ";").alias("numbers"))


@query(f"WITH t AS (SELECT event_id, user_id, {_SENT} AS s FROM events e), n AS (SELECT event_id, user_id, {_NUMS} AS ns FROM t) SELECT event_id, coalesce(user_id >= 0 AND len(list_filter(ns, lambda x: CASE WHEN user_id = 0 THEN abs(x) < 1e-9 ELSE abs(x - user_id) / abs(user_id) <= 0.01::DOUBLE END)) > 0, false) AS matched FROM n")
def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("event_id", X.numeric_match(F.col("user_id").cast("string"), "s").alias("matched"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE event_type END, ''), nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE props END, ''), user_id::VARCHAR) AS embed_text FROM events")
def fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, F.col("event_type"))
    b = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.first_filled(a, b, F.col("user_id").cast("string")).alias("embed_text"))


_RAW = """CASE event_id % 8 WHEN 0 THEN '{"action_code": "lookup"}' WHEN 1 THEN 'Sure: {"action_code": "compute", "k": 1} done' WHEN 2 THEN '' WHEN 3 THEN '{"action_code": "look' WHEN 4 THEN '["lookup"]' WHEN 5 THEN props WHEN 6 THEN '{"action_code": "dance"}' ELSE '{bad json}' END"""


@query(f"""WITH t AS (SELECT event_id, {_RAW} AS raw FROM events), b AS (SELECT event_id, raw, regexp_extract(raw, '(?s)\\{{.*\\}}') AS body FROM t),
c AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body::JSON ->> '$.action_code' END AS code FROM b),
s AS (SELECT event_id, code, CASE WHEN trim(raw) = '' THEN 'empty' WHEN body = '' OR NOT json_valid(body) THEN 'invalid_json' WHEN code IS NULL THEN 'missing_key' WHEN code NOT IN ('smalltalk', 'meta', 'lookup', 'compute', 'research', 'clarify', 'decline') THEN 'out_of_taxonomy' ELSE 'ok' END AS status FROM c)
SELECT event_id, CASE WHEN status = 'ok' THEN code END AS code, status FROM s""")
def json_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.parse_action(F.expr(_RAW)).alias("p")).select("event_id", "p.code", "p.status")


@query("SELECT 'Q' || item_id::VARCHAR AS id, 'T' || (item_id % 3)::VARCHAR AS company, (2000 + item_id % 20)::INT AS year, 'S' || (item_id % 4)::VARCHAR AS section, 'T' || (item_id % 3)::VARCHAR AS src_ticker FROM benchmark WHERE item_id % 5 > 0")
def struct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases flattened for review and nested again; rows that a reviewer struck out go."""
    n, none = F.col("item_id"), F.lit(None).cast("string")
    source = F.struct(F.concat(F.lit("T"), (n % 3).cast("string")).alias("ticker"), (2000 + n % 20).cast("int").alias("fiscal_year"), F.concat(F.lit("S"), (n % 4).cast("string")).alias("section"), none.alias("chunk_id"))
    params = F.struct(source["ticker"].alias("company"), source["fiscal_year"].alias("year"))
    cases = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Q"), n.cast("string")).alias("id"), F.col("text").alias("question"), none.alias("expected_answer"), F.lit("text").alias("answer_type"), source.alias("source"), params.alias("directive_params"), none.alias("question_type"))
    flat = files.review_rows(cases).withColumn("keep", F.when(F.substring("id", 2, 20).cast("long") % 5 == 0, "no").otherwise(" Yes"))
    again = files.reviewed_cases(flat.select(*(F.col(c).cast("string").alias(c) for c in flat.columns)))
    return again.select("id", "directive_params.company", "directive_params.year", "source.section", F.col("source.ticker").alias("src_ticker"))


@query(f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, text FROM documents) SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang, {_NORM} ORDER BY doc_id) AS rn FROM d) WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies within each language; documents without one are a group."""
    docs = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), "text")
    return dataset.keep_first(docs, ["lang"], "text", "doc_id")


@query(f"WITH g AS (SELECT lang, count(*) AS n_rows, count(DISTINCT {_NORM}) AS n_unique FROM documents GROUP BY lang) SELECT lang, level, n_rows::BIGINT AS n_rows, n_unique::BIGINT AS n_unique, round(1 - n_unique::DOUBLE / n_rows, 6) AS dup_rate FROM (SELECT lang, 'group' AS level, n_rows, n_unique FROM g UNION ALL SELECT NULL, 'total', sum(n_rows), sum(n_unique) FROM g)")
def dedup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.duplicate_rates(_docs(spark, sf_dir), "lang", "text")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delta_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label: those a delta run still has to do."""
    return _docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_LAB = "(SELECT conv_id, turn, role, text, 'c' || (length(text) % 7)::VARCHAR AS predicted_code FROM conversations)"
_OVR = f"(SELECT trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g')) AS norm, 'c' || (min(conv_id) % 7)::VARCHAR AS new_code FROM conversations WHERE turn = 0 AND conv_id % 3 = 0 GROUP BY 1 UNION ALL SELECT 'never asked', 'c0')"


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.concat(F.lit("c"), (F.length("text") % 7).cast("string")).alias("predicted_code"))


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "conversations").filter("turn = 0 AND conv_id % 3 = 0").groupBy(X.squeeze("text").alias("norm")).agg(F.concat(F.lit("c"), (F.min("conv_id") % 7).cast("string")).alias("new_code"))
    return first.unionAll(spark.createDataFrame([("never asked", "c0")], "norm string, new_code string"))


@query(f"SELECT conv_id, turn, coalesce(new_code, predicted_code) AS predicted_code, new_code IS NOT NULL AND new_code <> predicted_code AS override_applied FROM {_LAB} l LEFT JOIN {_OVR} o ON trim(regexp_replace(lower(l.text), '{_WS}+', ' ', 'g')) = o.norm")
def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.apply_overrides(_labeled(spark, sf_dir), _overrides(spark, sf_dir)).select("conv_id", "turn", "predicted_code", "override_applied")


@query(f"SELECT norm, new_code FROM {_OVR} o WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g')) = o.norm)")
def override_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.unmatched_overrides(_labeled(spark, sf_dir), _overrides(spark, sf_dir)).select("norm", "new_code")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(~F.col("quality").eqNullSafe(F.col("toxic"))).select("doc_id", "quality", "toxic")


_SPLIT = "s AS (SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split, text FROM (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents))"


def _split(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return dataset.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang", *extra), "lang", "doc_id")


@query(f"WITH {_SPLIT} SELECT doc_id, lang, split FROM s")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "lang", "split")


@query(f"""WITH {_SPLIT}, g AS (SELECT l.lang, p.split, p.target, count(s.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) p(split, target) LEFT JOIN s ON s.lang = l.lang AND s.split = p.split GROUP BY ALL)
SELECT 'preserved' AS "check", abs(count(*) - (SELECT count(*) FROM documents))::BIGINT AS issues FROM s
UNION ALL SELECT 'leakage', count(*) FROM (SELECT text FROM s GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'stratification', count(*) FILTER (abs(n::DOUBLE / t - target) > 0.05::DOUBLE) FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM g)
UNION ALL SELECT 'min_per_class', count(*) FILTER (n < 2) FROM g""")
def split_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    codes = [r[0] for r in docs.select("lang").distinct().collect()]  # one row a code
    rows = _split(spark, sf_dir, "text").withColumn("key", F.md5(F.col("text").cast("binary")))
    return dataset.split_gates(rows, docs.count(), codes, "lang", "key")


@query(f"WITH {_SPLIT}, g AS (SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s GROUP BY lang) SELECT lang, train::BIGINT AS train, val::BIGINT AS val, test::BIGINT AS test FROM (SELECT * FROM g UNION ALL SELECT 'TOTAL', sum(train), sum(val), sum(test) FROM g)")
def split_counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir)
    return s.rollup("lang").agg(*(F.count_if(F.col("split") == x).alias(x) for x in dataset.SPLITS), F.grouping("lang").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("lang")).alias("lang"), *dataset.SPLITS)


@query("""WITH n AS (SELECT ceil(100.0::DOUBLE / count(DISTINCT source)) AS k FROM documents), r AS (SELECT doc_id, source, md5('42:' || doc_id::VARCHAR) AS h, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rn FROM documents)
SELECT doc_id, source FROM r, n WHERE rn <= k ORDER BY h, doc_id LIMIT 100""")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.stratified_sample(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 100)


@query("SELECT doc_id, 'Classify.' AS instruction, md5(text) AS input_md5, source AS intended_code, lang AS predicted_code, source = lang AS agrees FROM documents")
def instruction_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("query"), F.col("source").alias("intended_code"), F.col("lang").alias("predicted_code"), (F.col("source") == F.col("lang")).alias("agrees"), F.lit("{}").alias("params"), F.lit("").alias("reasoning"))
    rec = rows.select("doc_id", F.struct(F.lit("Classify.").alias("instruction"), F.col("query").alias("input"), F.to_json(F.struct(F.col("predicted_code").alias("action_code"), "params", "reasoning")).alias("output"), F.struct("intended_code", "predicted_code", "agrees").alias("_meta")).alias("r"))
    return rec.select("doc_id", "r.instruction", F.md5(F.col("r.input").cast("binary")).alias("input_md5"), "r._meta.intended_code", "r._meta.predicted_code", "r._meta.agrees")


@query("SELECT quality, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement FROM labels GROUP BY quality")
def agreement_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("agreement"))


_PAIR = "(SELECT e.event_id, e.event_type AS truth, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (ARRAY['click', 'view', 'purchase', 'scroll', 'signup', 'error'])[(event_id % 6 + 1)::INT] END AS predicted FROM events e)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("click", "view", "purchase", "scroll", "signup", "error")))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("truth"), F.when(F.col("event_id") % 11 != 0, F.get(names, (F.col("event_id") % 6).cast("int"))).alias("predicted"))


def _codes(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # the taxonomy


@query(f"SELECT truth, predicted, count(*) AS count FROM {_PAIR} WHERE truth IS DISTINCT FROM predicted GROUP BY ALL ORDER BY count DESC, truth NULLS FIRST, predicted NULLS FIRST LIMIT 10")
def confusion_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top_confusions(_pairs(spark, sf_dir), "truth", "predicted")


@query(f"SELECT t.truth, p.predicted, count(x.event_id) AS n FROM (SELECT DISTINCT event_type AS truth FROM events) t CROSS JOIN (SELECT DISTINCT event_type AS predicted FROM events) p LEFT JOIN {_PAIR} x ON x.truth = t.truth AND x.predicted = p.predicted GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    wide = evaluation.confusion_matrix(_pairs(spark, sf_dir), codes)
    return wide.unpivot("truth", codes, "predicted", "n")


@query(f"""WITH x AS {_PAIR}, c AS (SELECT DISTINCT event_type AS code FROM events), k AS (SELECT code, (SELECT count(*) FROM x WHERE truth = code AND predicted = code) AS tp, (SELECT count(*) FROM x WHERE truth = code AND predicted IS NOT NULL) AS support, (SELECT count(*) FROM x WHERE predicted = code AND truth IN (SELECT code FROM c)) AS named FROM c),
m AS (SELECT code, support, CASE WHEN named = 0 THEN 0 ELSE tp::DOUBLE / named END AS p, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS r FROM k)
SELECT code, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, support FROM m""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.classification_report(_pairs(spark, sf_dir), _codes(spark, sf_dir))


@query(f"SELECT CASE WHEN predicted IS NULL THEN 'invalid_json' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (predicted = truth) AS n_correct, round((SELECT avg(CASE WHEN predicted = truth THEN 1 ELSE 0 END) FROM {_PAIR}), 6) AS accuracy_all FROM {_PAIR} GROUP BY 1")
def accuracy_with_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse failures count as wrong in the accuracy and are tallied by status."""
    x = _pairs(spark, sf_dir).withColumn("status", F.when(F.col("predicted").isNull(), "invalid_json").otherwise("ok")).withColumn("right", F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)))
    per = x.groupBy("status").agg(F.count("*").alias("n"), F.count_if("right").alias("n_correct"))
    total = per.agg(F.round(F.sum("n_correct") / F.sum("n"), 6).alias("accuracy_all"))
    return per.join(F.broadcast(total)).select("status", "n", "n_correct", "accuracy_all")


@query(f"SELECT truth AS event_type, CASE WHEN grouping(truth) = 1 THEN 'total' ELSE 'group' END AS level, count(*) AS n, round(coalesce(avg(CASE WHEN predicted = truth THEN 1 ELSE 0 END), 0), 6) AS accuracy FROM {_PAIR} GROUP BY GROUPING SETS ((truth), ())")
def correctness_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pairs(spark, sf_dir).select(F.col("truth").alias("event_type"), F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)).alias("correct"))
    return evaluation.correctness(x, "event_type")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS vals, count(DISTINCT lang) <> 4 AS flagged FROM documents GROUP BY source")
def coverage_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.coverage(_docs(spark, sf_dir), "source", "lang", 4)


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicates_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT source, min(doc_id) AS first_pos, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def section_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.crosstab(_docs(spark, sf_dir), "source", "lang", ["en", "de", "fr", "es"], "doc_id")


_TURNS = "(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'What was ' || upper(substring(role, 1, 4)) || ' revenue in 2023?' WHEN 2 THEN 'Should I buy this? ' || text ELSE 'Thanks, ' || text END AS q FROM conversations)"
_REASON = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{_quoted(p)}') THEN '{r}'" for r, p in answers.DECLINE.items()) + " END"
_ROUTE = f"""(SELECT conv_id, turn, reason, CASE WHEN reason IS NOT NULL THEN 'decline' WHEN regexp_matches(lower(q), '{answers.META}') THEN 'meta' WHEN regexp_matches(lower(q), '{answers.SOCIAL}') AND NOT contains(q, '?') THEN 'smalltalk'
 WHEN nc = 0 THEN 'clarify' WHEN nc > 1 OR ny > 1 THEN 'research' WHEN regexp_matches(lower(q), '{answers.COMPUTE}') THEN 'compute' ELSE 'lookup' END AS code
 FROM (SELECT conv_id, turn, q, {_REASON} AS reason, len(list_distinct(list_filter(regexp_extract_all(q, '{_quoted(answers.WORD)}'), lambda w: regexp_matches(w, '{answers.COMPANY}')))) AS nc, len(list_distinct(list_filter(regexp_extract_all(q, '{_quoted(answers.WORD)}'), lambda w: regexp_matches(w, '{answers.YEAR}')))) AS ny FROM {_TURNS}))"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 4
    q = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("What was "), F.upper(F.substring("role", 1, 4)), F.lit(" revenue in 2023?"))).when(kind == 2, F.concat(F.lit("Should I buy this? "), "text")).otherwise(F.concat(F.lit("Thanks, "), "text"))
    return conv.select("conv_id", "turn", q.alias("q")).withColumn("r", answers.route("q")).select("conv_id", "turn", "r.code", "r.reason")


@query(f"SELECT conv_id, turn, code, reason FROM {_ROUTE}")
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)


@query(f"""SELECT conv_id, turn, code AS action_code, CASE WHEN code IN ('smalltalk', 'meta') THEN 'ok' WHEN code = 'decline' OR code = 'lookup' AND conv_id % 2 = 1 THEN 'declined' WHEN code IN ('compute', 'research') THEN 'unsupported' WHEN code = 'lookup' THEN 'ok' ELSE 'clarify' END AS status,
 CASE WHEN code = 'lookup' AND conv_id % 2 = 0 THEN 1 ELSE 0 END::INT AS n_sources, CASE code WHEN 'smalltalk' THEN '{_quoted(answers.SMALLTALK_TEXT)}' WHEN 'meta' THEN '{_quoted(answers.META_TEXT)}' WHEN 'clarify' THEN '{_quoted(answers.CLARIFY_TEXT)}' WHEN 'compute' THEN '{_quoted(answers.UNSUPPORTED["compute"])}' WHEN 'research' THEN '{_quoted(answers.UNSUPPORTED["research"])}'
 WHEN 'decline' THEN CASE reason {" ".join(f"WHEN '{r}' THEN '{_quoted(t)}'" for r, t in answers.DECLINE_TEXTS.items())} END ELSE CASE WHEN conv_id % 2 = 0 THEN 'found [1]' ELSE 'No filings of ACME are in the corpus.' END END AS text FROM {_ROUTE}""")
def answer_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives to answers; the corpus covers conversations of even id."""
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    d = _routed(spark, sf_dir).withColumn("query_id", key).withColumn("company", F.lit("ACME")).withColumn("clarifying_question", F.lit(None).cast("string"))
    source = F.array(F.struct(F.lit("ACME").alias("ticker"), F.lit(2023).alias("fiscal_year"), F.lit("mdna").alias("section")))
    found = d.filter("conv_id % 2 = 0").select("query_id", F.lit("found [1]").alias("answer_text"), source.alias("sources"))
    a = answers.answer(d, found)
    ids = F.split("query_id", ":")
    return a.select(F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn"), "action_code", "status", F.size("sources").alias("n_sources"), "text")


@query("SELECT user_id, count(*) AS n_misses FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n_misses DESC, user_id LIMIT 10")
def miss_log_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: who asked most for what is not there."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n_misses")).orderBy(F.desc("n_misses"), "user_id").limit(10)


@query(r"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM documents) SELECT lang, sum(n)::BIGINT AS in_tokens, (count(*) * 100)::BIGINT AS out_tokens, round(sum(n) / 1e6 * 3 + count(*) * 100 / 1e6 * 15, 6) AS usd FROM t GROUP BY lang""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("lang", X.count_tokens("text").alias("n")).groupBy("lang").agg(F.sum("n").alias("in_tokens"), (F.count("*") * 100).alias("out_tokens"))
    return s.withColumn("usd", F.round(X.cost("in_tokens", "out_tokens"), 6))


@query("SELECT event_id, event_type, user_id FROM events")
def stream_delta_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.ingest_twice(spark, f"{sf_dir}/events.parquet", "event_id").select("event_id", "event_type", "user_id")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_demand_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = streams.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_to_table(streams.demand_counts(src, "ts", "event_type"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
SELECT 'distinct' AS op, count(*) AS n FROM a UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("distinct", a.distinct()).unionAll(n("except", a.distinct().exceptAll(b.distinct()))).unionAll(n("intersect", a.intersect(b))).unionAll(n("union_all", a.unionAll(b)))
