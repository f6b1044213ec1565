"""Small inputs that shape a plan: rules of users, prompts, languages. All of it is read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushspan.operators.gate import CATEGORIES

VERSION, MOST_RULES = 1, 2000


@dataclass
class Rules:
    rules: list[dict] = field(default_factory=list)
    corrupt: bool = False
    total: int = 0


def parse_rules(text: str) -> Rules:
    """A stored list; bad elements are passed over, a list of a newer version or unreadable text is corrupt."""
    try:
        found = json.loads(text)
        entries = found["rules"]
        if found.get("version", 1) > VERSION or not isinstance(entries, list):
            return Rules(corrupt=True)
    except (ValueError, KeyError, TypeError, AttributeError):
        return Rules(corrupt=True)
    good = [{"id": str(e["id"]), "name": e["name"], "pattern": e["pattern"], "is_enabled": bool(e.get("is_enabled", True)), "case_insensitive": bool(e.get("case_insensitive", False))} for e in entries if isinstance(e, dict) and all(isinstance(e.get(k), str) for k in ("id", "name", "pattern"))]
    return Rules(good, total=len(entries))


def load_rules(path: str) -> Rules:
    if not os.path.exists(path):
        return Rules()
    with open(path, encoding="utf-8", errors="replace") as f:
        return parse_rules(f.read())


def import_rules(text: str) -> Rules:
    """As parse_rules, for a file from elsewhere: corrupt ones and those of over MOST_RULES entries are refused."""
    found = parse_rules(text)
    if found.corrupt or found.total > MOST_RULES:
        raise ValueError("not a list of rules that can be taken over")
    return found


def save_rules(path: str, rules: list[dict]) -> None:
    """Sorted, indented JSON, put in place in one step; a corrupt file is kept beside it."""
    if load_rules(path).corrupt:
        os.replace(path, path + ".corrupt")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "rules": rules}, f, indent=2, sort_keys=True)
    os.replace(path + ".new", path)


def render_prompt(template: str, categories: list[str], text: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{categories}"), F.lit(", ".join(categories))), F.lit("{text}"), text)


def languages(preferred: Column, offered: Column) -> Column:
    """Preferred languages that are offered, in the order of preference; en-US if there is none."""
    both = F.array_intersect(preferred, offered)
    return F.when(F.size(both) == 0, F.array(F.lit("en-US"))).otherwise(both)


def dropped_languages(preferred: Column, offered: Column) -> Column:
    return F.array_except(preferred, offered)


def guard_output(source: str, target: str) -> None:
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("input and output are the same")

#: Used where no prompt file is given. {categories} and {text} are filled in.
PROMPT = {
    "instructions": "Find what identifies a person. Copy each value exactly as it stands in the text; leave out what merely describes.",
    "template": "Name every identifier in the text below, each with one of these categories: {categories}.\n\n{text}",
    "categories": CATEGORIES,
}
# Formats that a redacted document is written in, by the extension asked for.
DOCUMENT_TYPES = {"docx": "docx", "doc": "doc", "html": "html", "htm": "html", "odt": "odt"}


def load_prompt(path: str | None) -> dict:
    """The prompt of a JSON file; what the file lacks, or all of it if it can't be read, is that of PROMPT."""
    try:
        with open(path or "", encoding="utf-8") as f:
            found = json.load(f)
        return PROMPT | {k: v for k, v in found.items() if k in PROMPT}
    except (OSError, ValueError, AttributeError):
        return dict(PROMPT)


def document_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair]), ext), F.lit("rtf"))


def load_key(path: str) -> tuple[bytes, bool]:
    """(key, kept): the key of a file, made on first use; where it can't be kept, one for this run alone, which the caller
    should tell the user."""
    try:
        if not os.path.exists(path):
            with open(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "wb") as f:
                f.write(os.urandom(32))
        with open(path, "rb") as f:
            return f.read(), True
    except OSError:
        return os.urandom(32), False
