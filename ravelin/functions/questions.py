"""Question types and the evidence proxy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTH = r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
TIME = r"\b\d{1,2}:\d{2}\s*(?:am|pm)\b|\b(?:am|pm)\b"
DOMAIN = r"\b[a-z0-9][a-z0-9.-]+\.(?:com|org|edu|gov|net|io)\b"
ADDRESS = r"\b\d{1,5}\s+[a-z0-9.\-'\s]{2,40}\s(?:st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|way|pkwy|parkway)\b"
LIST_MARKER = r"(?:^|\n)\s*(?:[-*•]|\d+\.)\s+"
EVENT_DATE_TERMS = ["when", "date", "month", "year", "schedule", "upcoming", "event", "events", "festival", "concert", "performing", "performance", "show", "calendar"]
NUMERIC_TERMS = ["how many", "how much", "number of", "population", "percent", "percentage", "rank", "ranking", "cost", "price", "distance", "area", "size", "amount"]
LIST_TERMS = ["what are the names", "name the", "list", "which are", "what are the"]
LOCATION_TERMS = ["where", "located", "location", "address", "in pittsburgh"]
WEBSITE_TERMS = ["website", "url", "site", "webpage", "web page"]
STARTS = ["who ", "where ", "which ", "what is the name", "what is "]


def _has(c: Column, terms: list[str]) -> Column:
    """Substrings, not words."""
    return c.rlike("|".join(terms))


def question_type(question: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return (
        F.when(q == "", "description")
        .when(q.rlike(f"(?U){MONTH}|{YEAR}") | _has(q, EVENT_DATE_TERMS), "event_date")
        .when(_has(q, NUMERIC_TERMS), "numeric")
        .when(_has(q, LIST_TERMS), "list")
        .when(_has(q, LOCATION_TERMS + WEBSITE_TERMS) | q.rlike("^(" + "|".join(STARTS) + ")"), "entity_location")
        .otherwise("description")
    )


def evidence_hit(kind: Column, question: Column, text_blob: Column, meta_blob: Column, longest: Column) -> Column:
    """Whether retrieved texts look like they hold an answer; `longest` is the length of the longest stripped chunk."""
    q, blob = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.concat(text_blob, F.lit("\n"), meta_blob))
    count = lambda ch: F.length(text_blob) - F.length(F.replace(text_blob, F.lit(ch), F.lit("")))
    entity = (
        F.when(_has(q, WEBSITE_TERMS), blob.rlike(f"(?U){DOMAIN}"))
        .when(_has(q, LOCATION_TERMS) | q.contains("pittsburgh"), blob.contains("pittsburgh, pa") | blob.rlike(f"(?U){ADDRESS}"))
        .otherwise(longest > 60)
    )
    return (
        F.when(kind == "event_date", blob.rlike(f"(?U){MONTH}|{YEAR}|{TIME}"))
        .when(kind == "numeric", blob.rlike(r"(?U)\d"))
        .when(kind == "list", text_blob.rlike(LIST_MARKER) | (count(",") >= 3) | (count(";") >= 2))
        .when(kind == "entity_location", entity)
        .otherwise(longest > 80)
        .cast("int")
    )
