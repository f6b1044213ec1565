"""Detectors: each turns a column of texts into a column of span arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushspan.functions.entities import SPANS, let, no_spans, span
from hushspan.functions.rules import CODE_SHAPES, COLUMNS, DATA_RULES, GIVEN_NAMES, RULES, Rule, check
from hushspan.functions.spans import places, rules_spans

DATA, REGEX, DELIMITED, JSON, NAMES, COMMON, USER, MODEL = range(8)


def data_spans(text: Column) -> Column:
    """Phones, dates, links and street addresses by patterns of our own; no parity with a platform's detector is claimed."""
    return rules_spans(text, DATA_RULES, "dataDetector", DATA)


def regex_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    return rules_spans(text, list(rules), "regex", REGEX)


def _row(start: int, value: str, kind: str, how: str, confidence: float, source: str, detector: int, match: int) -> dict:
    return {"start": start, "end": start + len(value), "value": value, "type": kind, "confidence": confidence, "source": source, "disposition": how, "enabled": how == "redact", "detector_ord": detector, "match_ord": match}


def _claimed(name: str, value: str) -> tuple[str, str] | None:
    """What a column or key of this name holds, if its value may be claimed: values to be left in must look the part."""
    found = COLUMNS.get("".join(c for c in name.lower() if c.isalpha() or c.isnumeric()))
    if not found or not value or (found[1] == "flag" and not re.search(CODE_SHAPES[found[0]], value)):
        return None
    return found


def _cells(line: str, at: int, delimiter: str) -> list[tuple[int, str]]:
    """Offset and text of each field; delimiters inside double quotes don't count."""
    cells, begin, quoted = [], 0, False
    for i, c in enumerate(line):
        quoted ^= c == '"'
        if c == delimiter and not quoted:
            cells.append((at + begin, line[begin:i]))
            begin = i + 1
    return [*cells, (at + begin, line[begin:])]


def delimited(text: str) -> list[dict]:
    """Cells under known headers of a table whose rows all have the header's width; CRLF ends lines too."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    if lines[-1][1] == "":
        lines.pop()
    if len(lines) < 2:
        return []
    for delimiter in (",", "\t"):
        header = [c.strip() for _, c in _cells(lines[0][1], 0, delimiter)]
        known = [i for i, c in enumerate(header) if "".join(x for x in c.lower() if x.isalpha() or x.isnumeric()) in COLUMNS]
        if len(header) < 3 or not known:
            continue
        rows = [_cells(line, at, delimiter) for at, line in lines[1:] if line.strip()]
        if not rows or any(len(r) != len(header) for r in rows):
            continue
        out = []
        for row in rows:
            for i in known:
                at, cell = row[i]
                value = cell.strip(' \t"\r')
                if value and (found := _claimed(header[i], value)):
                    start = at + len(cell) - len(cell.lstrip(' \t"\r'))
                    out.append(_row(start, value, *found, 0.9, "structuredField", DELIMITED, len(out)))
        return out
    return []


KEY = re.compile(r'"([A-Za-z0-9_ .-]{1,64})"\s*:\s*')
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
NUMBER = re.compile(r"-?[0-9][0-9.]*")


def _elements(text: str, at: int) -> list[tuple[int, int]]:
    """Strings and numbers directly in the array that opens before `at`; none if it never closes."""
    found, depth = [], 0
    while at < len(text):
        c = text[at]
        if c == "]" and depth == 0:
            return found
        if c == '"':
            m = STRING.match(text, at)
            if not m:
                return []
            if depth == 0:
                found.append(m.span(1))
            at = m.end()
            continue
        if depth == 0 and (m := NUMBER.match(text, at)):
            found.append(m.span())
            at = m.end()
            continue
        depth += (c in "[{") - (c in "]}")
        at += 1
    return []


def json_fields(text: str) -> list[dict]:
    """Values next to known quoted keys: a string, a number, or what an array holds directly."""
    out = []
    for m in KEY.finditer(text):
        at = m.end()
        if at < len(text) and text[at] == "[":
            spans = _elements(text, at + 1)
        else:
            s = STRING.match(text, at)
            n = NUMBER.match(text, at)
            spans = [s.span(1)] if s else [n.span()] if n else []
        for a, b in spans:
            if found := _claimed(m[1], text[a:b]):
                out.append(_row(a, text[a:b], *found, 0.9, "structuredField", JSON, len(out)))
    return out


def _over_texts(function):
    """A span column by a Python function. It is declared nondeterministic so that the optimiser keeps it in a step of its
    own and doesn't copy it into what is built on it."""

    @F.pandas_udf(SPANS)
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([None if t is None else function(t) for t in texts], dtype=object)

    return run.asNondeterministic()


def delimited_spans(text: Column) -> Column:
    """Only texts of two lines or more whose first has two delimiters and a known header reach Python."""
    first = F.regexp_replace(F.lower(F.substring_index(text, "\n", 1)), r"[^\p{L}\p{N},\t]", "")
    known = F.exists(F.split(first, "[,\t]"), lambda h: h.isin(list(COLUMNS)))
    table = text.contains("\n") & first.rlike(r"[,\t].*[,\t]") & known
    return F.coalesce(_over_texts(delimited)(F.when(table, text)), no_spans())


def json_spans(text: Column) -> Column:
    return F.coalesce(_over_texts(json_fields)(F.when(text.rlike(r'"[A-Za-z0-9_ .-]{1,64}"\s*:'), text)), no_spans())


def common_name_spans(text: Column, names: Sequence[str] = GIVEN_NAMES) -> Column:
    """Words that are given names in any case."""
    known = sorted({n.lower() for n in names})
    words = F.filter(places(text, r"(?U)\b\p{L}[\p{L}'\-]+\b"), lambda m: F.lower(m["value"]).isin(known))
    low = F.lower(text)
    hit = F.exists(F.split(low, r"[^\p{L}'\-]+"), lambda w: w.isin(known))
    return F.when(hit, F.transform(words, lambda m, i: span(m["start"], m["value"], "name", 0.5, "commonName", "redact", COMMON, i))).otherwise(no_spans())


def common_names(df: DataFrame, names: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, start, value) of words found in a table of names (name): for lists too long for a plan."""
    words = df.select(id, F.explode(places(F.col("text"), r"(?U)\b\p{L}[\p{L}'\-]+\b")).alias("w")).select(id, F.col("w.start").alias("start"), F.col("w.value").alias("value"))
    return words.join(names.select(F.lower("name").alias("known")).distinct(), F.lower("value") == F.col("known"), "left_semi")


# Titles, and the words that make a phrase a condition or an instrument.
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sr|Sra|Rev"
EPONYM = r"\b[A-Z][A-Za-z'’-]*['’]s[ \t](?:disease|syndrome|reflex|phenomenon|triad|manoeuvre|maneuver|gland)\b"
INSTRUMENT = r"\b[A-Z][A-Za-z]*(?:[ -][A-Z][A-Za-z]*){1,3}[ ](?:Inventory|Questionnaire|Battery|Subscale)(?:-(?:[IVXL]+|[0-9]+))?\b"
TITLE_BEFORE = rf"(?:^|\s)(?:{TITLES})(?:\.\s*|\s+)$"


def name_spans(text: Column, names: Sequence[str] = GIVEN_NAMES) -> Column:
    """A heuristic in place of a trained tagger: capitalised words after a title, a given name with the capitalised words
    after it, and single capitalised words of eponyms and instruments; those last are then judged by drop_frames."""
    word = r"\p{Lu}\p{L}*+(?:['’\-]\p{Lu}\p{L}*+)*+"  # never goes back: no recursion over long chains
    run = rf"{word}(?:[ ]{word}){{0,3}}"
    titled = rf"(?<=\b(?:{TITLES})\.?[ ])(?:{run})"
    given = "(?:" + "|".join(sorted({n.capitalize() for n in names} | {n.upper() for n in names})) + rf")(?:[ ]{word}){{1,3}}"
    eponym = r"\b\p{Lu}[\p{L}\-]+(?=['’]s[ ](?:disease|syndrome|reflex)\b)"
    found = places(text, rf"(?U)\b(?:{given})|{titled}|{eponym}")
    spans = F.transform(found, lambda m, i: span(m["start"], m["value"], "name", 0.6, "nameEntity", "redact", NAMES, i))
    # the cheap test: a known name, a title or the end of an eponym stands somewhere
    known = sorted({n.lower() for n in names} | set(TITLES.lower().split("|")))
    low = F.lower(text)
    hit = F.exists(F.split(low, r"[^\p{L}]+"), lambda w: w.isin(known)) | low.rlike("['’]s[ ](?:disease|syndrome|reflex)")
    return F.when(hit, drop_frames(spans, text, names)).otherwise(no_spans())


def drop_frames(spans: Column, text: Column, names: Sequence[str] = GIVEN_NAMES) -> Column:
    """Without the single words inside the name of a condition or an instrument, unless a title stands before the word or
    the frame holds a given name."""
    known = sorted({n.lower() for n in names})
    frames = F.concat(places(text, EPONYM), places(text, INSTRUMENT))

    def judged(f: Column) -> Column:
        def keeps(s: Column) -> Column:
            around = F.filter(f, lambda x: (x["start"] <= s["start"]) & (s["end"] <= x["start"] + F.length(x["value"])))
            before = F.regexp_replace(F.substring(text, F.greatest(s["start"] - 7, F.lit(1)), F.least(s["start"], F.lit(8))), r"\R", " ")
            named = F.exists(around, lambda x: F.exists(F.split(F.lower(x["value"]), r"[^\p{L}]+"), lambda w: w.isin(known)))
            return (F.size(around) == 0) | s["value"].rlike(r"[\s\-]") | before.rlike(TITLE_BEFORE) | named

        return F.filter(spans, keeps)

    return let(frames, lambda f: F.when(F.size(f) == 0, spans).otherwise(judged(f)))


def title_cased(text: str) -> str:
    """First letter of each word upper, the rest lower, of the same length; a digit doesn't start a word."""
    out, inside = [], False
    for c in text:
        new = c
        if c.isalpha():
            new = c.lower() if inside else c.upper()
            inside = True
        elif not (c.isnumeric() or c in "'’"):
            inside = False
        out.append(new if len(new) == 1 else c)
    return "".join(out)


def title_case(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(title_cased, na_action="ignore")

    return run(text)


def merged(first: Column, second: Column) -> Column:
    """Spans of the first pass with those of the second that cover new ground; a later span that swallows all it touches
    replaces it."""

    def add(kept: Column, s: Column) -> Column:
        touches = lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])
        swallowed = F.forall(F.filter(kept, touches), lambda k: (s["start"] <= k["start"]) & (k["end"] <= s["end"]))
        same = F.exists(kept, lambda k: (k["start"] == s["start"]) & (k["end"] == s["end"]))
        return F.when(swallowed & ~same, F.concat(F.filter(kept, lambda k: ~touches(k)), F.array(s))).otherwise(kept)

    return F.aggregate(second, first, add)


#: Seconds that a rule of a user may take over one text.
BUDGET = 0.25


def usable(rules: Sequence[dict]) -> tuple[list[dict], list[str]]:
    """(enabled rules that compile, names of the enabled ones that don't)."""
    on = [r for r in rules if r.get("is_enabled", True)]
    bad = [r["name"] for r in on if check(r["pattern"])]
    return [r for r in on if r["name"] not in bad], bad


def user_spans(text: Column, rules: Sequence[dict]) -> Column:
    """struct<spans, timed_out>: spans of a user's rules, each within its time budget, and names of the rules over it."""
    good, _ = usable(rules)

    @F.pandas_udf(f"struct<spans:{SPANS}, timed_out:array<string>>")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [(r["name"], regex.compile(r["pattern"], regex.IGNORECASE if r.get("case_insensitive") else 0)) for r in good]
        for texts in column:
            spans, late = [], []
            for t in texts:
                own, over = [], []
                for i, (name, pattern) in enumerate(compiled):
                    try:
                        found = [(m.start(), m[0]) for m in pattern.finditer(t or "", timeout=BUDGET) if m[0]]
                    except TimeoutError:
                        over.append(name)
                        continue
                    own += [_row(a, v, "custom", "redact", 0.8, "userRule", USER, i * 100_000 + k) for k, (a, v) in enumerate(found)]
                spans.append(own)
                late.append(sorted(over))
            yield pd.DataFrame({"spans": spans, "timed_out": late})

    return run.asNondeterministic()(text)
