"""PII rule registry.

A rule is (name, pattern, replacement, description). Rules are applied in
registry order, case-insensitively, with Unicode-aware ``\\b \\d \\s``.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PiiRule:
    name: str
    pattern: str
    replacement: str
    description: str

    @property
    def java_pattern(self) -> str:
        # (?i) case-insensitive, (?U) Unicode character classes (also implies
        # Unicode case folding), matching Python's str-pattern semantics.
        return "(?iU)" + self.pattern


# The eight built-in rules, verbatim and in application order
# (name, pattern, replacement, description). They must equal the reference's
# rules for masked text, counts and spans to agree.
BUILTIN_RULES = (
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "XXX-XX-XXXX", "Social Security Number"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "XXXX-XXXX-XXXX-XXXX", "Credit Card Number"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]", "Email Address"),
    ("phone", r"\b\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "(XXX) XXX-XXXX", "Phone Number"),
    ("date_of_birth", r"\b(?:DOB|Date of Birth|Birth Date):\s*\d{1,2}/\d{1,2}/\d{4}\b", "DOB: XX/XX/XXXX", "Date of Birth"),
    ("drivers_license", r"\b(?:DL|Driver'?s? License|License)[\s#:]+[A-Z0-9]{5,15}\b", "DL: XXXXXXXXX", "Driver's License"),
    ("bank_account", r"\b(?:Account|Acct)[\s#:]+\d{8,17}\b", "Account: XXXXXXXXXX", "Bank Account Number"),
    ("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", "VIN: XXXXXXXXXXXXX", "Vehicle Identification Number"),
)


# What every match of a rule contains. Texts without it skip the rule's regex
# pass; the result is the same because no match is possible. Only characters
# that no other character folds to may stand for letters (so not i, k, s), and
# digits are those of every script, as in the rules.
REQUIRED_CHAR = {"ssn": "-", "email": "@", "date_of_birth": "/"}
REQUIRED_LETTERS = {"drivers_license": ("dl", "cen"), "bank_account": ("acc",)}
REQUIRED_PATTERN = {"credit_card": r"\p{Nd}{4}", "phone": r"\p{Nd}{4}"}


def may_match(rule: PiiRule, text: Column) -> Column | None:
    """A cheap necessary condition for a match of a built-in rule in ``text``
    (None for changed and custom rules)."""
    if {r[0]: r[1] for r in BUILTIN_RULES}.get(rule.name) != rule.pattern:
        return None
    if rule.name in REQUIRED_CHAR:
        return F.contains(text, F.lit(REQUIRED_CHAR[rule.name]))
    if rule.name in REQUIRED_LETTERS:
        return functools.reduce(operator.or_, (F.contains(F.lower(text), F.lit(x)) for x in REQUIRED_LETTERS[rule.name]))
    if rule.name in REQUIRED_PATTERN:
        return F.rlike(text, F.lit(REQUIRED_PATTERN[rule.name]))
    return None


class PiiRegistry:
    """Ordered rule registry. ``add_custom`` appends a rule, or overwrites a
    rule of the same name in place (keeping its position)."""

    def __init__(self, rules=BUILTIN_RULES):
        self._rules: "OrderedDict[str, PiiRule]" = OrderedDict()
        for r in rules:
            rule = r if isinstance(r, PiiRule) else PiiRule(*r)
            self._rules[rule.name] = rule

    def copy(self) -> "PiiRegistry":
        return PiiRegistry(list(self._rules.values()))

    @property
    def names(self) -> list[str]:
        return list(self._rules)

    def __getitem__(self, name: str) -> PiiRule:
        return self._rules[name]

    def __contains__(self, name: str) -> bool:
        return name in self._rules

    def select(self, types=None) -> list[PiiRule]:
        """Rules to apply for ``types``: ``None`` means all in registry order;
        otherwise the caller's order, unknown names skipped, repeats kept."""
        if types is None:
            return list(self._rules.values())
        return [self._rules[t] for t in types if t in self._rules]

    def add_custom(self, name: str, pattern: str, replacement: str, description: str) -> "PiiRegistry":
        validate_rule(pattern, replacement)
        self._rules[name] = PiiRule(name, pattern, replacement, description)
        return self


_PY_ONLY = ("(?P<", "(?P=", "(?#")


def validate_rule(pattern: str, replacement: str) -> None:
    """Reject rules whose meaning would differ between engines.

    The replacement is inserted literally, so Python group references are
    refused; so are Python-only constructs and patterns that can match the
    empty string (they would split text between every character).
    """
    compiled = re.compile(pattern, re.IGNORECASE)
    if any(tok in pattern for tok in _PY_ONLY):
        raise ValueError("Python-only regex syntax is not supported")
    if compiled.fullmatch("") is not None or compiled.search("") is not None:
        raise ValueError("pattern must not match the empty string")
    if re.search(r"\\(\d|g<)", replacement):
        raise ValueError("group references in replacements are not supported")


DEFAULT_REGISTRY = PiiRegistry()
