"""Schemas and fixed vocabularies of the engine."""

from __future__ import annotations

# The action codes, the decline reasons, the item numbers of annual reports, the sections of dense text, and below the
# names and types of the records that are exchanged.
ACTION_CODES = ("smalltalk", "meta", "lookup", "compute", "research", "clarify", "decline")
DECLINE_REASONS = ("investment_advice", "prediction", "out_of_scope", "personal_financial_advice")
ITEM_SECTIONS = {
    "1": "business",
    "1a": "risk_factors",
    "1b": "unresolved_staff_comments",
    "1c": "cybersecurity",
    "2": "properties",
    "3": "legal_proceedings",
    "4": "mine_safety",
    "5": "market_for_equity",
    "6": "reserved",
    "7": "mdna",
    "7a": "market_risk",
    "8": "financials",
    "9": "accountant_changes",
    "9a": "controls_procedures",
    "9b": "other_information",
    "9c": "foreign_jurisdictions",
    "10": "directors_officers",
    "11": "executive_compensation",
    "12": "security_ownership",
    "13": "related_transactions",
    "14": "accountant_fees",
    "15": "exhibits",
    "16": "form_summary",
}
PARSE_STATUSES = ("ok", "empty", "invalid_json", "missing_key", "out_of_taxonomy")
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
DENSE_SECTIONS = ("business", "risk_factors", "mdna", "financials")

# Schemas, as DDL.
CHUNK = "ticker string, filing_type string, fiscal_year int, period_of_report string, accession_number string, section string, content_type string, text string, chunk_index int, n_tokens int"
PARAMS = (
    "company string, year int, fact_requested string, concept string, calculation string, companies array<string>,"
    " year_range array<int>, metrics array<string>, missing_info array<string>, clarifying_question string, reason string"
)
DIRECTIVE = "action_code string, params struct<" + ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in PARAMS.split(","))) + ">, reasoning string"
ANSWER = "text string, action_code string, status string, sources array<struct<ticker: string, fiscal_year: int, section: string>>"
EVAL_CASE = (
    "id string, question string, expected_answer string, answer_type string,"
    " source struct<ticker: string, fiscal_year: int, section: string, chunk_id: string>, directive_params struct<company: string, year: int>, question_type string"
)
LABELED = "query string, intended_code string, predicted_code string, params string, reasoning string, agrees boolean, override_applied boolean"
SPLIT_RECORD = "instruction string, input string, output string, _meta struct<intended_code: string, predicted_code: string, agrees: boolean>"
MISS = "ts double, query string, filters map<string, string>"
