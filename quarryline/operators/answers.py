"""Routing rules and the dispatch of directives to uniform answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.schemas import ACTION_CODES, PARAMS

#: Patterns of the offline router; both Java and RE2 read them.
DECLINE = {
    "investment_advice": r"should (i|we) (buy|sell|hold|invest)|worth (buying|investing)|good (buy|investment)",
    "prediction": r"(will|going to) (rise|fall|go up|go down|crash|beat)|price target|forecast|predict",
    "personal_financial_advice": r"my (portfolio|retirement|savings|401k|taxes)",
    "out_of_scope": r"weather|recipe|poem|10-q|8-k",
}
META = r"what can you do|who are you|how do (i|you) (use|work)|can you (read|help)|your (capabilities|limits)"
SOCIAL = r"^\s*(hi|hello|hey|thanks|thank you|good (morning|evening)|bye|ok|great)([^a-z]|$)"
COMPUTE = r"margin|ratio|growth rate|percent|per share|difference|compute|calculate|sum of|average"
WORD = r"""[^ \t\n\r.,;:!?()'"]+"""
COMPANY = r"^[A-Z]{2,5}$"
YEAR = r"^(19|20)[0-9]{2}$"

SMALLTALK_TEXT = "Glad to help. Ask about a company's annual report."
META_TEXT = "This service looks up facts in annual reports and cites where they stand."
CLARIFY_TEXT = "Which company and year do you mean?"
REPHRASE_TEXT = "Could you put the question another way?"
DECLINE_TEXTS = {
    "investment_advice": "Advice to buy, sell or hold is not given here; facts from filings are.",
    "prediction": "Prices and outcomes are not predicted here; disclosures from filings are reported.",
    "out_of_scope": "That lies outside annual reports.",
    "personal_financial_advice": "Personal finance, tax and retirement advice is not given here.",
}
GENERIC_DECLINE = "That can't be answered here, but questions about annual reports can."
UNSUPPORTED = {"compute": "Calculations on filing data are not built yet.", "research": "Analysis across companies or years is not built yet."}


def route(query: Column | str) -> Column:
    """struct<code, reason> by the ordered rules: decline, meta, social, missing context, many companies or years, arithmetic, look-up."""
    q = F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit(""))
    low = F.lower(q)
    words = F.array_distinct(F.regexp_extract_all(q, F.lit(WORD), F.lit(0)))
    n_company, n_year = F.size(F.filter(words, lambda w: w.rlike(COMPANY))), F.size(F.filter(words, lambda w: w.rlike(YEAR)))
    reason = F.coalesce(*(F.when(low.rlike(p), r) for r, p in DECLINE.items()))
    code = (
        F.when(reason.isNotNull(), "decline").when(low.rlike(META), "meta").when(low.rlike(SOCIAL) & ~low.contains("?"), "smalltalk")
        .when(n_company == 0, "clarify").when((n_company > 1) | (n_year > 1), "research").when(low.rlike(COMPUTE), "compute").otherwise("lookup")
    )
    return F.struct(code.alias("code"), reason.alias("reason"))


def parse_directive(raw: Column | str) -> Column:
    """struct<action_code, params, reasoning> of a router's raw output: fences off, JSON, taxonomy.

    What can't be parsed and what names an unknown code asks to clarify, and its reasoning says why; missing params are all null.
    """
    r = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    body = X.strip_fences(r)
    parsed = F.when(body.startswith("{"), F.try_parse_json(body))
    code = F.coalesce(F.try_variant_get(parsed, "$.action_code", "string"), F.lit(""))
    params = F.from_json(F.coalesce(F.get_json_object(body, "$.params"), F.lit("{}")), f"struct<{PARAMS}>")
    fields = [x.strip().split(" ")[0] for x in PARAMS.split(", ")]
    ask = F.struct(*(F.lit(REPHRASE_TEXT).alias(f) if f == "clarifying_question" else F.lit(None).cast(params_type(f)).alias(f) for f in fields))
    unknown = F.concat(F.lit("no such action: "), code)
    failed = F.concat(F.lit("no directive to be read in: "), r)
    ok = parsed.isNotNull() & code.isin(*ACTION_CODES)
    reason = F.coalesce(F.try_variant_get(parsed, "$.reasoning", "string"), F.lit(""))
    return F.struct(F.when(ok, code).otherwise("clarify").alias("action_code"), F.when(ok, params).otherwise(ask).alias("params"), F.when(parsed.isNull(), failed).when(~ok, unknown).otherwise(reason).alias("reasoning"))


def params_type(name: str) -> str:
    """Type of a parameter of directives."""
    return next(x.strip().split(" ", 1)[1] for x in PARAMS.split(", ") if x.strip().split(" ")[0] == name)


def decline_text(reason: Column | str) -> Column:
    r = F.col(reason) if isinstance(reason, str) else reason
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DECLINE_TEXTS.items() for x in kv)), r), F.lit(GENERIC_DECLINE))


def answer(directives: DataFrame, lookups: DataFrame | None = None, computed: DataFrame | None = None) -> DataFrame:
    """query_id, text, action_code, status from (query_id, code, reason, company, clarifying_question).

    ``lookups`` (query_id, answer_text, sources) holds what retrieval and
    generation found; a look-up without a row there is declined.  ``computed`` (query_id, computed_text, computed_status)
    holds results of calculations; without it they are unsupported.  Unknown codes ask to rephrase.
    """
    df = directives
    if computed is not None:
        df = df.join(computed, "query_id", "left")
    else:
        df = df.withColumns({"computed_text": F.lit(None).cast("string"), "computed_status": F.lit(None).cast("string")})
    if lookups is not None:
        df = df.join(lookups, "query_id", "left")
    else:
        df = df.withColumn("answer_text", F.lit(None).cast("string")).withColumn("sources", F.lit(None).cast("array<struct<ticker:string,fiscal_year:int,section:string>>"))
    code = F.col("code")
    found = F.col("answer_text").isNotNull()
    none = F.concat(F.lit("No filings of "), F.coalesce("company", F.lit("that company")), F.lit(" are in the corpus."))
    text = (
        F.when(code == "smalltalk", SMALLTALK_TEXT).when(code == "meta", META_TEXT)
        .when(code == "clarify", X.first_filled("clarifying_question", F.lit(CLARIFY_TEXT)))
        .when(code == "decline", decline_text("reason"))
        .when(code == "compute", F.coalesce("computed_text", F.lit(UNSUPPORTED["compute"]))).when(code == "research", UNSUPPORTED["research"])
        .when(code == "lookup", F.when(found, F.col("answer_text")).otherwise(none)).otherwise(REPHRASE_TEXT)
    )
    status = (
        F.when(code.isin("smalltalk", "meta"), "ok").when(code == "decline", "declined").when(code == "compute", F.coalesce("computed_status", F.lit("unsupported"))).when(code == "research", "unsupported")
        .when(code == "lookup", F.when(found, "ok").otherwise("declined")).otherwise("clarify")
    )
    return df.select("query_id", text.alias("text"), code.alias("action_code"), status.alias("status"), F.when((code == "lookup") & found, F.col("sources")).otherwise(F.array()).alias("sources"))


def context_blocks(hits: DataFrame, key: str = "query_id", rank: str = "rank", head: str = "head", text: str = "text") -> DataFrame:
    """One block for each query: ``[rank] head`` and the text, parts separated by a blank line, in order of rank."""
    part = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col(head), F.lit("\n"), F.col(text))
    return hits.withColumn("__part", part).groupBy(key).agg(F.expr(f"listagg(__part, '\n\n') WITHIN GROUP (ORDER BY {rank})").alias("context"))


def research_plan(directives: DataFrame) -> DataFrame:
    """One row for each company and year a research directive names: query_id, ticker, fiscal_year."""
    years = F.when(F.size("params.year_range") == 2, F.sequence(F.get("params.year_range", F.lit(0)), F.get("params.year_range", F.lit(1)))).otherwise(F.array("params.year"))
    return directives.select("query_id", F.explode("params.companies").alias("company"), years.alias("years")).select("query_id", X.normalize_ticker("company").alias("ticker"), F.explode("years").alias("fiscal_year"))


def chat_messages(query: Column | str, system: str, shots: list[tuple[str, str]] = ()) -> Column:
    """array<struct<role, content>>: system text, worked examples as turns, then the query."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    q = F.col(query) if isinstance(query, str) else query
    examples = [turn(r, F.lit(t)) for u, a in shots for r, t in (("user", u), ("assistant", a))]
    return F.array(turn("system", F.lit(system)), *examples, turn("user", q))
