"""The bundled pattern rules. Each has a cheap test that clean texts fail before any pattern runs."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    type: str
    pattern: str
    confidence: float
    ignore_case: bool = False
    disposition: str = "redact"
    #: Words of which a lower-cased text must hold one; none: the pattern itself is the test.
    needs: tuple[str, ...] = ()
    #: A pattern without boundaries or flags that any match holds, cheaper than the whole.
    hint: str = ""
    #: For patterns that repeat a group, which Java matches by recursion: a pattern that never goes back over the group and
    #: finds all that may hold a match, and what of it is the match. Results are those of `pattern`.
    chain: str = ""
    inside: str = ""

    @property
    def java(self) -> str:
        """The pattern for Java, with Unicode-aware classes."""
        return self.flags + (self.chain or self.pattern)

    @property
    def flags(self) -> str:
        return "(?iU)" if self.ignore_case else "(?U)"


# Parts of the rule for domains.
_LABELS = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)"
_TOP = "(?:com|org|net|edu|gov|io|co|mil|int|uk|de|fr|ca|au|nl|ch|eu|us)"
# The shape of a phone; the rule bounds it.
PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}"

# Patterns, confidences and dispositions that results depend on, in the order that breaks ties.
RULES = [
    Rule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.92, needs=("-",), hint=r"\p{Nd}-\p{Nd}"),
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.9, needs=("@",)),
    Rule("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.8, needs=(".",), hint=r"\p{Nd}\.\p{Nd}"),
    Rule("mrn", r"\b(?i:MRN)[:#]?\s?[A-Z0-9]{5,12}\b", 0.85, needs=("mrn",)),
    Rule("account", r"\b(?:Acct|Account)[:#]?\s?\d{6,17}\b", 0.75, True, needs=("acct", "account"), hint=r"\p{Nd}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", 0.95, needs=("eyj",)),
    Rule("license", r"\b(?:DLN|DL|Driver'?s?\s?Licen[sc]e)(?:\s?(?:no|number|#))?[:#]?\s?(?=[A-Z0-9-]*\d)[A-Z0-9-]{5,15}\b", 0.8, True, needs=("dl", "driver"), hint=r"\p{Nd}"),
    Rule("age", r"\b(?:age[:#]?\s?\d{1,3}|\d{1,3}\s?(?:y/?o|yo|years?\s?old))\b", 0.6, True, needs=("age", "yo", "y/o", "year"), hint=r"\p{Nd}"),
    Rule("sex", r"\b(?:sex|gender)[:#]?\s?(?:male|female|nonbinary|non-binary|m|f)\b", 0.7, True, needs=("sex", "ſex", "gender")),
    Rule("race", r"\b(?:race|ethnicity)[:#]?\s?(?:White|Black|African[\s-]?American|Asian|Hispanic|Latin[oax]|Caucasian|Native[\s-]?American|American[\s-]?Indian|Alaska[\s-]?Native|Pacific[\s-]?Islander|Native[\s-]?Hawaiian|Middle[\s-]?Eastern|Multiracial|Biracial)\b", 0.7, True, needs=("race", "ethnicity")),
    Rule("marital", r"\b(?:marital[\s-]?status|marital)[:#]?\s?(?:Single|Married|Divorced|Widowed|Widower|Widow|Separated|Partnered|Domestic[\s-]?Partner|Civil[\s-]?Union|Engaged)\b", 0.65, True, needs=("marital",)),
    Rule("zip", r"\b(?:zip\s?code|postal\s?code|zip)[:#]?\s?\d{5}(?:-\d{4})?\b", 0.7, True, needs=("zip", "postal"), hint=r"\p{Nd}"),
    Rule("group", r"""\b(?:group\s?(?:number|no\.?|num|#)?)["']?[:=#]?\s{0,3}["']?(?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]{2,15}\b""", 0.7, True, needs=("group",), hint=r"\p{Nd}"),
    Rule("testid", r"\b(?:test\s?id|test\s?(?:number|no\.?|#)|accession(?:\s?(?:number|no\.?|#|id))?)[:#]?\s?(?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]{3,20}\b", 0.7, True, needs=("test", "teſt", "accession"), hint=r"\p{Nd}"),
    Rule("date", r"\b(?:Jan(?:uary)?|JAN(?:UARY)?|Feb(?:ruary)?|FEB(?:RUARY)?|Mar(?:ch)?|MAR(?:CH)?|Apr(?:il)?|APR(?:IL)?|May|MAY|Jun(?:e)?|JUN(?:E)?|Jul(?:y)?|JUL(?:Y)?|Aug(?:ust)?|AUG(?:UST)?|Sep(?:t(?:ember)?)?|SEP(?:T(?:EMBER)?)?|Oct(?:ober)?|OCT(?:OBER)?|Nov(?:ember)?|NOV(?:EMBER)?|Dec(?:ember)?|DEC(?:EMBER)?)\.?,?\s+(?:18|19|20)\d{2}\b", 0.8, needs=("18", "19", "20"), hint=r"\p{Nd}"),
    Rule("domain", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+(?:com|org|net|edu|gov|io|co|mil|int|uk|de|fr|ca|au|nl|ch|eu|us)\b", 0.75, True, needs=(".com", ".org", ".net", ".edu", ".gov", ".io", ".co", ".mil", ".int", ".uk", ".de", ".fr", ".ca", ".au", ".nl", ".ch", ".eu", ".us"), chain=rf"\b{_LABELS}++(?:{_TOP}\b)?", inside=rf"^.*\.{_TOP}\b"),
    Rule("beneficiary", r"""\b(?:member|subscriber|policy|beneficiary|insured|enrollee)\s?(?:id|ident(?:ifier)?|number|no\.?|#)?["']?\s{0,3}[:=#]?\s{0,3}["']?(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9][A-Za-z0-9-]{4,24}\b""", 0.85, True, needs=("member", "subscriber", "policy", "beneficiary", "insured", "enrollee"), hint=r"\p{Nd}"),
    Rule("cpt", r"""\b(?:cpt|hcpcs|procedure|proc\.?|service)\s?(?:code)?["']?\s?[:=#]?\s?["']?\d{5}\b""", 0.95, True, "flag", needs=("cpt", "hcpcs", "proc", "service"), hint=r"\p{Nd}"),
    Rule("icd10", r"\b[A-TV-Z][0-9][0-9AB]\.[0-9A-TV-Z]{1,4}\b", 0.9, disposition="flag", needs=(".",), hint=r"[A-TV-Z][0-9][0-9AB]\."),
    Rule("icd10", r"""\b(?:icd(?:-?10)?|dx|diagnosis)\s?(?:code)?["']?\s?[:=#]?\s?["']?[A-TV-Z][0-9][0-9AB]\b(?!\.)""", 0.9, True, "flag", needs=("icd", "dx", "diagnosis"), hint=r"[0-9]"),
]

# What the platform's own detector is stood in for (phone, dates, links, street addresses).
DATA_RULES = [
    Rule("phone", rf"(?<![\w.]){PHONE}(?!\w)", 0.85, hint=r"\p{Nd}[ .-]\p{Nd}"),
    Rule("date", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{1,2},? \d{4})\b", 0.85, hint=r"\p{Nd}"),
    Rule("url", r"\bhttps?://[^\s<>\"']+[^\s<>\"'.,;:!?)]", 0.85, True, needs=("http",)),
    Rule("address", r"\b\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way)\b\.?", 0.85, hint=r"\p{Nd} [A-Z]"),
]

# Column and key names that hold a person, normalised, with what they hold.
_REDACTED = {
    "beneficiary": ["memberid", "membernumber", "memberno", "subscriberid", "policyid", "policynumber", "beneficiaryid", "insuredid", "enrolleeid"],
    "mrn": ["mrn", "medicalrecordnumber", "medicalrecordno", "patientid", "chartnumber"],
    "ssn": ["ssn", "socialsecuritynumber"],
    "dob": ["dob", "dateofbirth", "birthdate"],
    "name": ["membername", "patientname", "subscribername", "beneficiaryname", "insuredname"],
    "address": ["address", "address1", "addressline1", "streetaddress", "street", "city", "town", "zip", "zipcode", "postalcode", "postcode"],
}
_FLAGGED = {"cpt": ["cpt", "cptcode", "hcpcs", "procedurecode"], "icd10": ["dx", "diagnosis", "diagnosiscode", "icd", "icd10"]}
COLUMNS = {name: (kind, how) for table, how in ((_REDACTED, "redact"), (_FLAGGED, "flag")) for kind, names in table.items() for name in names}
CODE_SHAPES = {"cpt": "^[0-9]{5}$|^[A-Za-z][0-9]{4}$", "icd10": r"^[A-TVa-tv-z][0-9][0-9ABab](\.[0-9A-TVa-tv-z]{1,4})?$"}

# Given names known by default; a longer list is a parameter of the detectors.
GIVEN_NAMES = [
    "alice", "anna", "maria", "jose", "john", "james", "sarah", "fatima", "janice", "marc", "mary", "robert", "linda", "michael", "david", "susan", "karen",
    "priya", "raj", "amit", "ahmed", "omar", "layla", "yusuf", "mei", "wei", "jun", "hiroshi", "yuki", "kenji", "sofia", "carlos", "luis", "ana", "miguel", "elena", "ivan", "olga",
]


def check(pattern: str) -> str | None:
    """Why a pattern can't be used, or None. A rule that matches the empty text is none."""
    try:
        return "matches the empty text" if re.compile(pattern).match("") else None
    except re.error as e:
        return str(e)
