"""Queries that run whole operators end to end: filings to chunks, outputs to scores, questions to answers.

Their inputs are made of the tables, as the engine's own documents are not among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import answers, chunking, dataset, evaluation, evalset, ingest, pipeline, retrieval
from quarryline.plans.chunks import _UNITS, OVERLAP, TARGET, pack_sql
from quarryline.plans.registry import query, table
from quarryline.providers import ExtractiveGenerator, HashedEmbedder, JsonLabeler, label_column
from quarryline.schemas import ACTION_CODES

#: Item numbers of the headings before every fourth line, in turn; the last is no item of a report.
_ITEMS = ("1", "1A", "7", "99")


def _kind(name: str) -> Column:
    return F.when(F.col("doc_id") % 9 == 0, name)


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission for each document: a heading before every fourth line, a table behind every fifth; some are broken."""
    lines = X.paragraphs("text", "\n")
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = lambda i: F.get(F.array(*map(F.lit, _ITEMS)), (F.floor(i / 4) % 4).cast("int"))
    head = lambda i: F.when(i % 4 == 0, F.concat(F.lit("<h2>Item&#160;"), item(i), F.lit(". Heading</h2>"))).otherwise("")
    grid = lambda i: F.when(i % 5 == 4, F.concat(F.lit("<table><tr><th>Key</th><th>Value</th></tr><tr><td>k</td><td>"), i.cast("string"), F.lit("</td></tr></table>"))).otherwise("")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(head(i), F.lit("<p>"), esc(x), F.lit("</p>"), grid(i))), "")
    html = F.concat(F.lit("<XBRL><html><head><title>t</title></head><body>"), body, F.lit("</body></html></XBRL>"))
    n = F.col("doc_id")
    kind = F.when(n % 9 == 0, "10-K/A").otherwise("10-K")
    document = F.when(n % 9 == 2, F.concat(F.lit("<DOCUMENT>\n<TYPE>10-K\n</DOCUMENT>\n"))).otherwise(F.concat(F.lit("<DOCUMENT>\n<TYPE>EX-99\n<TEXT>ignored</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<TEXT>"), html, F.lit("</TEXT>\n</DOCUMENT>\n")))
    period = F.when(n % 9 == 1, "").otherwise(F.concat(F.lit("CONFORMED PERIOD OF REPORT:\t"), (2000 + n % 20).cast("string"), F.lit("0131\n")))
    accession = F.format_string("%010d-24-%06d", n, n)
    anchor = F.when(n % 11 == 3, "/data/other/").otherwise("/data/sec-edgar-filings/")
    path = F.concat(anchor, F.upper("lang"), F.lit("/10-K/"), accession, F.lit("/full-submission.txt"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.concat(F.lit("ACCESSION NUMBER:\t"), F.when(n % 13 == 5, "0").otherwise(accession), F.lit("\nCONFORMED SUBMISSION TYPE:\t10-K\n"), period, document).alias("content"))


_OK = "doc_id % 9 NOT IN (0, 1, 2) AND doc_id % 11 <> 3"
_ACC = "printf('%010d', doc_id) || '-24-' || printf('%06d', doc_id)"
#: Lines with the section that holds there: each known heading opens a run.
_RUNS = f"""{_UNITS.replace("FROM documents", f"FROM documents WHERE {_OK}")},
o AS (SELECT *, CASE WHEN (i - 1) % 4 = 0 THEN (['business', 'risk_factors', 'mdna', NULL])[((i - 1) // 4) % 4 + 1] END AS opens FROM u),
w AS (SELECT *, sum(CASE WHEN opens IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i)::INT AS run, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM o)"""
_RECORDS = f"""r AS (SELECT doc_id, run, section, 'narrative' AS content_type, string_agg(unit, chr(10) || chr(10) ORDER BY i) AS text FROM w GROUP BY doc_id, run, section
  UNION ALL SELECT doc_id, run, section, 'table', '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| k | ' || (i - 1)::VARCHAR || ' |' FROM w WHERE (i - 1) % 5 = 4)"""


@query(f"SELECT upper(lang) AS ticker, doc_id AS n, CASE WHEN doc_id % 9 = 1 THEN NULL ELSE 2000 + doc_id % 20 END::INT AS fiscal_year, {_ACC} AS accession_number, CASE WHEN doc_id % 11 = 3 THEN 'no_ticker_in_path' WHEN doc_id % 9 = 0 THEN 'no_document' WHEN doc_id % 9 = 2 THEN 'no_text' WHEN doc_id % 9 = 1 THEN 'missing_period_of_report' ELSE 'ok' END AS status, '10-K' AS filing_type FROM documents WHERE doc_id % 11 <> 3")
def filing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapping: the header, the primary document and the error of every filing whose folder names a company."""
    un = ingest.unwrap(_submissions(spark, sf_dir)).filter("status <> 'no_ticker_in_path'")
    return un.select("ticker", F.substring("accession_number", 1, 10).cast("long").alias("n"), "fiscal_year", "accession_number", "status", "filing_type")


@query(f"SELECT {_ACC} AS accession_number, CASE WHEN doc_id % 13 = 5 THEN '0' ELSE {_ACC} END AS header_accession FROM documents WHERE doc_id % 13 = 5")
def filing_accession_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accession_mismatches(_submissions(spark, sf_dir)).select("accession_number", "header_accession")


@query(f"WITH {_RUNS}, {_RECORDS} SELECT {_ACC} AS accession_number, section, content_type, md5(text) AS text_md5, length(text)::INT AS chars FROM r")
def ingest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings to section records: parsed elements, sections carried forward, narratives gathered, tables alone."""
    records = ingest.section_records(ingest.parsed(ingest.unwrap(_submissions(spark, sf_dir))))
    return records.select("accession_number", "section", "content_type", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("chars"))


_KEYED = _RUNS.replace("u AS (", "u0 AS (", 1).replace("FROM u)", "FROM u0)") + ", u AS (SELECT doc_id::VARCHAR || ':' || run::VARCHAR AS k, i, unit, t FROM w)"


@query(
    pack_sql(_KEYED, "k", delimiter="chr(10) || chr(10)")
    + f""", s AS (SELECT DISTINCT doc_id, doc_id::VARCHAR || ':' || run::VARCHAR AS k, section FROM w)
SELECT {_ACC} AS accession_number, section, 'narrative' AS content_type, chunk_index, n_tokens, md5(chunk) AS text_md5 FROM z JOIN s ON z.k = s.k
UNION ALL SELECT {_ACC}, section, 'table', 0, 15, md5('| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| k | ' || (i - 1)::VARCHAR || ' |') FROM w WHERE (i - 1) % 5 = 4"""
)
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from submissions to chunks, long units split and tables whole."""
    chunks, _ = ingest.chunk_filings(_submissions(spark, sf_dir), target=TARGET, overlap=OVERLAP)
    return chunks.select("accession_number", "section", "content_type", "chunk_index", "n_tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT {_ACC} AS accession_number, CASE WHEN doc_id % 11 = 3 THEN 'no_ticker_in_path' WHEN doc_id % 9 = 0 THEN 'no_document' WHEN doc_id % 9 = 2 THEN 'no_text' ELSE 'missing_period_of_report' END AS status FROM documents WHERE NOT ({_OK}) AND doc_id % 2 = 1")
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a delta run: filings of even number are in the corpus already and aren't read again."""
    subs = _submissions(spark, sf_dir)
    done = subs.select(X.accession_from_path("path").alias("accession_number")).filter(F.substring("accession_number", 1, 10).cast("long") % 2 == 0)
    _, errors = ingest.chunk_filings(subs, done, target=TARGET, overlap=OVERLAP)
    return errors.select("accession_number", "status")


# --- model outputs -----------------------------------------------------------------------------

_OUT = """CASE event_id % 6 WHEN 0 THEN '{"action_code": "lookup"}' WHEN 1 THEN 'Sure: {"action_code": "compute"} done' WHEN 2 THEN '' WHEN 3 THEN '{"action_code": "look' WHEN 4 THEN '{"action_code": "dance"}' ELSE '{"k": 1}' END"""
_TRUTH = """CASE event_id % 4 WHEN 0 THEN '{"predicted_code": "lookup", "_meta": {"predicted_code": "clarify"}}' WHEN 1 THEN '{"_meta": {"predicted_code": "compute"}}' WHEN 2 THEN '{"_meta": {}}' ELSE '{"predicted_code": null, "_meta": {"predicted_code": "meta"}}' END"""


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'compute' END AS truth FROM events")
def truth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true code of a record: its own field if it has it, else the one below ``_meta``."""
    return table(spark, sf_dir, "events").select("event_id", evaluation.truth_of(F.expr(_TRUTH)).alias("truth"))


@query("""WITH t AS (SELECT event_id, (['ok', 'ok', 'empty', 'invalid_json', 'out_of_taxonomy', 'missing_key'])[event_id % 6 + 1] AS status, (['lookup', 'compute', NULL, NULL, NULL, NULL])[event_id % 6 + 1] AS predicted, CASE event_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'compute' END AS truth FROM events)
SELECT status, predicted, truth, coalesce(predicted = truth, false) AS correct, count(*) AS n FROM t GROUP BY ALL""")
def score_model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs parsed and scored against the records' truth; a failed parse is wrong and keeps its status."""
    rows = table(spark, sf_dir, "events").select(F.expr(_OUT).alias("raw_output"), evaluation.truth_of(F.expr(_TRUTH)).alias("truth"))
    return evaluation.score_outputs(rows, ACTION_CODES).groupBy("status", "predicted", "truth", "correct").agg(F.count("*").alias("n"))


_ROUTER = """CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"action_code": "lookup", "params": {"company": "ACME", "year": 2023}, "reasoning": "r"}' || chr(10) || '```' WHEN 1 THEN 'no json' WHEN 2 THEN '{"action_code": "dance"}' WHEN 3 THEN '{"action_code": "compute", "params": null}' WHEN 4 THEN '{"params": {"year": 1}}' ELSE '' END"""


@query(f"""SELECT event_id, (['lookup', 'clarify', 'clarify', 'compute', 'clarify', 'clarify'])[event_id % 6 + 1] AS action_code, CASE WHEN event_id % 6 = 0 THEN 'ACME' END AS company, CASE WHEN event_id % 6 IN (0, 3) THEN NULL ELSE '{answers.REPHRASE_TEXT}' END AS clarifying_question,
CASE event_id % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'no directive to be read in: no json' WHEN 2 THEN 'no such action: dance' WHEN 3 THEN '' WHEN 4 THEN 'no such action: ' ELSE 'no directive to be read in: ' END AS reasoning FROM events""")
def router_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router's raw output to a directive; what can't be read asks to clarify."""
    d = table(spark, sf_dir, "events").select("event_id", answers.parse_directive(F.expr(_ROUTER)).alias("d"))
    return d.select("event_id", "d.action_code", "d.params.company", "d.params.clarifying_question", "d.reasoning")


@query("SELECT event_id, (['lookup', 'meta', NULL])[event_id % 3 + 1] AS code FROM events")
def label_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a provider that fails for some queries: those are null and the others unharmed."""
    q = F.concat(F.get(F.array(F.lit("lookup"), F.lit("meta"), F.lit("fail")), (F.col("event_id") % 3).cast("int")), F.lit(" this"))
    raw = label_column(table(spark, sf_dir, "events").select("event_id", q.alias("query")), JsonLabeler(), wait=0.0)
    return raw.select("event_id", X.parse_action("raw_output").getField("code").alias("code"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g')), ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(trim(regexp_replace(lower(role || ' ' || left(text, 40)), '[\\s\\x0B]+', ' ', 'g')), ' '), lambda w: w <> '')) AS y FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS f1 FROM t""")
def judge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline judge's measure: words that an answer and its expectation share."""
    c = table(spark, sf_dir, "conversations").withColumn("other", F.concat_ws(" ", "role", F.left("text", F.lit(40))))
    return c.select("conv_id", "turn", F.round(evaluation.token_f1("text", "other"), 6).alias("f1"))


# --- retrieval and answers ---------------------------------------------------------------------


@query("""SELECT event_id AS query_id, CASE event_id % 3 WHEN 0 THEN 'fact ' || user_id::VARCHAR WHEN 1 THEN 'concept' ELSE event_type END AS embed_text, CASE WHEN event_id % 4 > 0 THEN 'BRK-B' END AS ticker, CASE WHEN event_id % 5 > 0 THEN 2020 + event_id % 5 END::INT AS fiscal_year FROM events""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to embed and what to filter by, from a directive's parameters; empty ones say nothing."""
    n = F.col("event_id")
    params = F.struct(
        F.when(n % 4 == 0, "").otherwise(" brk.b ").alias("company"), F.when(n % 5 > 0, 2020 + n % 5).alias("year"),
        F.when(n % 3 == 0, F.concat(F.lit("fact "), F.col("user_id").cast("string"))).when(n % 3 == 1, "").alias("fact_requested"), F.when(n % 3 == 1, "concept").otherwise("").alias("concept"),
    )
    return retrieval.search_terms(table(spark, sf_dir, "events").select(n.alias("query_id"), F.col("event_type").alias("query"), params.alias("params"))).select("query_id", "embed_text", "ticker", "fiscal_year")


@query("SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 3 = 0")
def retrieve_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose filter no row meets: what the miss log gets."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    queries = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("label")).alias("label"))
    return retrieval.retrieve(emb, queries)[1].select("query_id")


@query("SELECT doc_id, contains(lower(text), 'the') AS has_it, replace(left(text, 200), chr(10), ' ') AS preview FROM documents")
def substring_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fact's words stand in a text, with its beginning on one line."""
    return retrieval.previews(table(spark, sf_dir, "documents").select("doc_id", "text"), ["THE"]).select("doc_id", "has_it", "preview")


@query("SELECT count(*) AS n_rows, count(CASE WHEN vec_id % 7 > 0 THEN 1 END) AS n_embedded FROM embeddings")
def embedded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a vector table, and those that have a vector."""
    return retrieval.embedded_rows(table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 > 0, F.col("embedding"))))


def _quoted(s: str) -> str:
    return s.replace("'", "''")


_REASONS = tuple(answers.DECLINE_TEXTS) + ("other",)


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{_quoted(answers.DECLINE_TEXTS.get(r, answers.GENERIC_DECLINE))}'" for i, r in enumerate(_REASONS)) + f" ELSE '{_quoted(answers.GENERIC_DECLINE)}' END AS text FROM events")
def decline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text for each reason to decline; an unknown or missing reason gets the general one."""
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", answers.decline_text(reason).alias("text"))


_ASKED = "(SELECT event_id AS query_id, CASE event_id % 5 WHEN 0 THEN 'Should I buy EN stock?' WHEN 1 THEN 'hello' WHEN 2 THEN 'What was the revenue?' WHEN 3 THEN 'What was ZZ revenue in 2005?' ELSE 'What was ' || (['DE', 'EN', 'FR', 'ES'])[event_id % 4 + 1] || ' revenue in ' || (2000 + event_id % 20)::VARCHAR || '?' END AS query, (['DE', 'EN', 'FR', 'ES'])[event_id % 4 + 1] AS ticker, 2000 + event_id % 20 AS fiscal_year FROM events)"


@query(f"""WITH one AS (SELECT upper(lang) AS ticker, 2000 + doc_id % 20 AS fiscal_year, min(doc_id) AS doc_id FROM documents WHERE regexp_full_match(text, '(?s).*[^\\s].*') GROUP BY ALL), corpus AS (SELECT one.*, left(trim(replace(text, chr(10), ' ')), 300) AS body FROM one JOIN documents d ON one.doc_id = d.doc_id),
q AS (SELECT a.query_id, a.query_id % 5 AS kind, a.ticker, c.body FROM {_ASKED} a LEFT JOIN corpus c ON a.query_id % 5 = 4 AND a.ticker = c.ticker AND a.fiscal_year = c.fiscal_year)
SELECT query_id, CASE kind WHEN 0 THEN '{_quoted(answers.DECLINE_TEXTS["investment_advice"])}' WHEN 1 THEN '{_quoted(answers.SMALLTALK_TEXT)}' WHEN 2 THEN '{_quoted(answers.CLARIFY_TEXT)}' WHEN 3 THEN 'No filings of ZZ are in the corpus.' ELSE CASE WHEN body IS NULL THEN 'No filings of ' || ticker || ' are in the corpus.' ELSE body || ' [1]' END END AS text,
 (['decline', 'smalltalk', 'clarify', 'lookup', 'lookup'])[kind + 1] AS action_code, CASE kind WHEN 0 THEN 'declined' WHEN 1 THEN 'ok' WHEN 2 THEN 'clarify' WHEN 3 THEN 'declined' ELSE CASE WHEN body IS NULL THEN 'declined' ELSE 'ok' END END AS status, CASE WHEN body IS NULL THEN 0 ELSE 1 END::INT AS n_sources FROM q""")
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to answer in one run: route, filter, embed, search, generate, dispatch; one chunk for each company and year."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(?s)\S")).select(F.upper("lang").alias("ticker"), (2000 + F.col("doc_id") % 20).cast("int").alias("fiscal_year"), "doc_id", F.trim(F.translate("text", "\n", " ")).alias("text"))
    first = docs.groupBy("ticker", "fiscal_year").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("vec_id")).withColumn("section", F.lit("mdna"))
    n = F.col("event_id")
    company = F.get(F.array(*map(F.lit, ("DE", "EN", "FR", "ES"))), (n % 4).cast("int"))
    asked = F.when(n % 5 == 0, "Should I buy EN stock?").when(n % 5 == 1, "hello").when(n % 5 == 2, "What was the revenue?").when(n % 5 == 3, "What was ZZ revenue in 2005?").otherwise(F.concat(F.lit("What was "), company, F.lit(" revenue in "), (2000 + n % 20).cast("string"), F.lit("?")))
    found, _ = pipeline.answer_questions(table(spark, sf_dir, "events").select(n.alias("query_id"), asked.alias("query")), first, HashedEmbedder(64), ExtractiveGenerator(), k=3)
    return found.select("query_id", "text", "action_code", "status", F.size("sources").alias("n_sources"))


# --- data sets ---------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT doc_id, upper(lang) AS ticker, (2000 + doc_id % 20)::INT AS fiscal_year, text, printf('%06d', doc_id) || '#' || (doc_id % 3)::VARCHAR AS chunk_id FROM documents WHERE n_chars >= 400),
k AS (SELECT *, md5(chunk_id || '|mdna|' || text) AS key FROM c), n AS (SELECT ceil(40.0::DOUBLE / count(DISTINCT ticker)) AS m FROM k), r AS (SELECT *, md5('42:' || key) AS h, row_number() OVER (PARTITION BY ticker ORDER BY md5('42:' || key), key) AS rn FROM k),
p AS (SELECT r.*, list_filter(string_split(regexp_replace(trim(left(text, 4000), ' ' || chr(9) || chr(10) || chr(13)), '[\\s\\x0B]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM r, n WHERE rn <= m ORDER BY h, key LIMIT 40)
SELECT 'eval_' || left(key, 8) AS id, 'What does the passage on ' || array_to_string(ws[1:5], ' ') || ' state?' AS question, coalesce(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))[1], array_to_string(ws[1:8], ' ')) AS expected_answer, CASE WHEN len(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))) > 0 THEN 'numeric' ELSE 'text' END AS answer_type, ticker, fiscal_year, chunk_id FROM p""")
def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases over dense chunks, spread over companies; a sampling operator of forty cases."""
    n = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select(F.upper("lang").alias("ticker"), (2000 + n % 20).cast("int").alias("fiscal_year"), F.lit("mdna").alias("section"), F.format_string("%06d", n).alias("accession_number"), (n % 3).cast("int").alias("chunk_index"), "text", F.when(F.col("n_chars") >= 400, 80).otherwise(0).alias("n_tokens"))
    cases = evalset.eval_cases(chunks, evalset.FirstNumberWriter())
    return cases.select("id", "question", "expected_answer", "answer_type", "source.ticker", "source.fiscal_year", "source.chunk_id")


@query("SELECT doc_id, 'Classify.' AS system, md5(text) AS user_md5, '{\"action_code\":\"' || lang || '\",\"params\":{},\"reasoning\":\"\"}' AS assistant FROM documents")
def sft_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records as chat turns, the whole way from labelled rows."""
    rows = table(spark, sf_dir, "documents").select(F.struct("doc_id", "text").alias("both"), F.to_json(F.struct("doc_id", "text")).alias("query"), F.col("source").alias("intended_code"), F.col("lang").alias("predicted_code"), F.lit(True).alias("agrees"), F.lit("{}").alias("params"), F.lit("").alias("reasoning"))
    m = dataset.sft_messages(dataset.instruction_record(rows, "Classify.")).select(F.get("messages", F.lit(0)).alias("s"), F.get("messages", F.lit(1)).alias("u"), F.get("messages", F.lit(2)).alias("a"))
    asked = F.from_json("u.content", "doc_id long, text string")
    return m.select(asked["doc_id"].alias("doc_id"), F.col("s.content").alias("system"), F.md5(asked["text"].cast("binary")).alias("user_md5"), F.col("a.content").alias("assistant"))


_GAP = r"""regexp_extract_all({}, '[^ \t\n\r\f\x0B]+')"""


@query(f"WITH {_UNITS}, p AS (SELECT doc_id, sum(t) AS parts, len({_GAP.format('string_agg(unit, chr(10) ORDER BY i)')}) AS whole FROM u GROUP BY doc_id) SELECT doc_id, (whole - parts)::INT AS gap FROM p")
def additivity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a whole text beyond the sum of its units: none for a counter of words."""
    units = X.paragraphs("text", "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", units.alias("u")).filter(F.size("u") > 0)
    parts = F.aggregate(F.transform("u", X.count_tokens), F.lit(0), lambda a, b: a + b)
    return docs.select("doc_id", (X.count_tokens(F.array_join("u", "\n")) - parts).alias("gap"))
