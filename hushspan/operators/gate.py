"""Findings of a language model: anchored in the text, then held against what the other detectors found."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hushspan.functions.entities import SPANS
from hushspan.functions.rules import GIVEN_NAMES
from hushspan.operators.detect import MODEL, _row

FLOOR = 0.5
FINDINGS = "array<struct<type:string,value:string,confidence:double>>"
# Categories offered to the model; particles of names; words that identify nobody.
CATEGORIES = ["NAME", "ADDRESS", "ZIP", "DOB", "DATE", "PHONE", "FAX", "EMAIL", "SSN", "MRN", "ACCOUNT", "LICENSE", "BENEFICIARY", "IP", "URL", "DEVICE", "VEHICLE", "AGE", "SEX", "RACE", "MARITAL", "OTHER"]
PARTICLES = {"van", "von", "de", "del", "della", "da", "das", "di", "do", "dos", "du", "la", "le", "las", "los", "der", "den", "el", "san", "santa", "st", "ste", "bin", "ibn", "abu", "ben", "al", "mac", "mc", "ter", "ten", "y", "e"}
FILLERS = {
    "a", "the", "this", "that", "these", "those", "here", "there", "then", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "has", "have", "had",
    "i", "you", "she", "they", "it", "me", "us", "them", "him", "my", "your", "our", "their", "his", "her", "its", "mine", "yours", "ours", "theirs",
    "of", "to", "in", "on", "at", "for", "with", "from", "by", "as", "about", "into", "onto", "over", "and", "or", "but", "if", "than", "because", "while", "when", "where", "which", "who", "whom",
    "hey", "hello", "yeah", "yep", "okay", "please", "thanks", "thank", "yes", "not", "ssn", "dob", "phone", "email", "address", "name",
    "patient", "patients", "client", "clients", "member", "subscriber", "interpreter", "provider", "clinician", "counselor", "counsellor", "therapist", "therapy",
    "session", "sessions", "visit", "visits", "encounter", "chart", "history", "treatment", "assessment", "referral", "discharge", "admission", "score", "scores",
}


def anchored(findings: list[dict], text: str) -> list[dict]:
    """Each finding at the next occurrence of its value that none before it has taken; those not in the text go."""
    taken: list[tuple[int, int]] = []
    out = []
    for i, f in enumerate(findings):
        at = text.find(f["value"]) if f["value"] else -1
        while at >= 0 and any(a < at + len(f["value"]) and at < b for a, b in taken):
            at = text.find(f["value"], at + 1)
        if at >= 0:
            taken.append((at, at + len(f["value"])))
            out.append(_row(at, f["value"], f["type"].lower(), "redact", min(1.0, max(0.0, f["confidence"])), "foundationModel", MODEL, i))
    return out


def only_fillers(value: str, names: set[str]) -> bool:
    if any(c.isnumeric() for c in value):
        return False
    words = "".join(c if c.isalpha() or c == "'" else " " for c in value).lower().split()
    return bool(words) and not any(w in names for w in words) and all(w in FILLERS for w in words)


def is_acronym(value: str, names: set[str]) -> bool:
    """MMSE, PHQ-9: two to five capitals, with one or two digits at most behind a hyphen, and no given name."""
    letters, dash, digits = value.partition("-")
    fits = letters.isalpha() and 2 <= len(letters) <= 5 and letters.isupper()
    return fits and value.lower() not in names and (not dash or (digits.isnumeric() and len(digits) <= 2))


def leading_name(value: str) -> str | None:
    """The part before the first later word in lower case that is no particle; None if the value isn't of that shape."""
    tokens, at, capital = value.split(), 0, False
    for i, token in enumerate(tokens):
        at = value.index(token, at)
        capital |= token[0].isupper()
        if i and token[0].islower() and token.lower() not in PARTICLES:
            return value[:at].strip() or None if capital else None
        at += len(token)
    return None


def gated(model: list[dict], others: list[dict], text: str, names: set[str]) -> list[dict]:
    """The model's spans that stand: surely enough, no filler, and backed by another detector where they are weak."""
    out = []
    for s in model:
        backed = any(s["start"] < o["end"] and o["start"] < s["end"] for o in others)
        if s["confidence"] < FLOOR or only_fillers(s["value"], names) or (s["type"] == "other" and not backed):
            continue
        if s["type"] == "other":
            out.append(s)
            continue
        loose = s["type"] == "name" or s["type"].upper() not in CATEGORIES
        bare = s["value"].isnumeric() and len(s["value"]) <= 4
        if loose and not backed and (bare or is_acronym(s["value"], names)):
            continue
        head = leading_name(s["value"])
        if head is None or not text[s["start"] :].startswith(head):
            out.append(s)
        elif " " in head or any(s["start"] < o["end"] and o["start"] < s["start"] + len(head) for o in others):
            out.append(s | {"value": head, "end": s["start"] + len(head)})
    return out


def gate(findings: Column, spans: Column, text: Column, names: Sequence[str] = GIVEN_NAMES) -> Column:
    """SPANS of the findings (FINDINGS, in order) that stand beside the other detectors' spans."""
    known = {n.lower() for n in names}

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, others, texts in batches:
            yield pd.Series([gated(anchored([dict(x) for x in f], t), [dict(x) for x in o], t, known) if f is not None and t else [] for f, o, t in zip(found, others, texts, strict=True)], dtype=object)

    return run.asNondeterministic()(findings, spans, text)
