"""Content safety: predicates over text, mostly as one regular expression in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.errors import DEPTH_LIMIT, INVALID_JSON, SECURITY_VIOLATION, SIZE_LIMIT, JsonError
from docloom.functions import values
from docloom.functions.columns import native_nesting  # noqa: F401

#: Texts that make a document dangerous.
DANGEROUS = (
    "__proto__", "constructor[", "prototype.", "<script", "<iframe", "<object", "<embed", "<svg", "javascript:", "vbscript:",
    "eval(", "setTimeout(", "setInterval(", "require(", "new function(", "document.cookie", "window.location", "innerhtml",
    "fromcharcode(", "atob(", "expression(", "onerror", "onload", "onclick", "onmouseover", "onfocus", "__defineGetter__",
    "__defineSetter__",
)
#: Parts of names and texts that point to secrets or personal data.
SENSITIVE = (
    "password", "passwd", "pwd", "token", "bearer", "jwt", "access_token", "refresh_token", "auth_token", "secret", "secret_key",
    "client_secret", "apikey", "api_key", "api-key", "x-api-key", "auth", "authorization", "authenticate", "credential",
    "credentials", "private", "ssn", "social_security", "social_security_number", "credit_card", "creditcard", "card_number",
    "cvv", "cvc", "passport", "passport_number", "driver_license", "license_number", "account_number", "bank_account",
    "routing_number", "pin", "pin_number", "private_key", "public_key", "encryption_key", "signing_key", "certificate",
    "private_certificate", "session", "session_id", "session_key", "cookie", "csrf", "xsrf", "database_url", "db_password",
    "db_user", "db_pass", "connection_string", "connectionstring", "aws_access_key", "aws_secret", "aws_key", "azure_key",
    "gcp_key", "gcp_credentials",
)

_registry: dict[str, None] = {}


def register(pattern: str) -> None:
    """Scan for one more text, from now on."""
    _registry[pattern] = None


def unregister(pattern: str) -> None:
    _registry.pop(pattern, None)


def registered() -> list[str]:
    return list(_registry)


def _bounded(pattern: str) -> str:
    """A pattern where it isn't part of a longer word, but at its own delimiters."""
    before = "" if pattern[0] in "<{[(" else r"(?<![A-Za-z0-9_])"
    after = "" if pattern[-1] in "([{:." else r"(?![A-Za-z0-9_])"
    return before + re.escape(pattern) + after


def dangerous_regex(config: Config = DEFAULT) -> str:
    return "(?i)" + "|".join(map(_bounded, dict.fromkeys((*DANGEROUS, *_registry, *config.patterns))))


#: Texts that large documents may not hold even within longer words, and the size from which that holds.
CRITICAL, LARGE = ("__proto__", "constructor[", "prototype."), 4_096


def is_dangerous(text: Column | str, config: Config = DEFAULT) -> Column:
    """Whether a text holds one of the patterns, anywhere, in any case; in a text of LARGE bytes or more the critical ones count
    within words, too. NULL for NULL."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(dangerous_regex(config)) | ((F.octet_length(c) >= LARGE) & reduce(or_, [c.contains(x) for x in CRITICAL]))


def _minimal(words: tuple[str, ...]) -> list[str]:
    """Words that no other word is part of: containing one of these is containing any."""
    return [w for w in words if not any(v != w and v in w for v in words)]


def is_sensitive(text: Column | str) -> Column:
    """Whether a document's text holds one of the sensitive parts, in names or values."""
    c = F.col(text) if isinstance(text, str) else text
    any_of = lambda t: reduce(or_, [t.contains(w) for w in _minimal(SENSITIVE)])
    return F.exists(F.array(F.lower(c)), any_of)  # so that the lower case is made once


def _scanner(config: Config) -> Callable[[str], bool]:
    """Whether dangerous_regex finds something in a text. The expression tries each pattern at each place, so only those patterns
    are tried that the text holds in some case at all."""
    patterns = dict.fromkeys((*DANGEROUS, *_registry, *config.patterns))
    tried = [(_folded(p) if p.isascii() else "", re.compile("(?i)" + _bounded(p))) for p in patterns]

    def dangerous(text: str) -> bool:
        folded = _folded(text)
        return any(word in folded and pattern.search(text) for word, pattern in tried)

    return dangerous


def _folded(text: str) -> str:
    """Lower case, and the ASCII letters that (?i) takes other letters for."""
    return (text if text.isascii() else text.translate({0x130: "i", 0x131: "i", 0x17F: "s"})).lower()


def json_input_error(doc: Column | str, config: Config = DEFAULT) -> Column:
    """The code of what keeps a document from being taken in, or NULL: its size, a byte order mark, its patterns, its nesting, its
    syntax. Equal documents of a batch are looked at once."""
    dangerous = _scanner(config)

    def code(d: str | None) -> str | None:
        if not d or d.startswith("\ufeff"):
            return INVALID_JSON
        size = len(d) if d.isascii() else len(d.encode("utf-8", "surrogatepass"))
        if size > config.max_json_size:
            return SIZE_LIMIT
        if not config.skip_validation and (dangerous(d) or size >= LARGE and any(x in d for x in CRITICAL)):
            return SECURITY_VIOLATION
        if d.count("[") + d.count("{") > config.max_depth and nesting(d) > config.max_depth:
            return DEPTH_LIMIT
        try:
            values.loads(d, config)
        except JsonError as e:
            return e.code
        return None

    def run(docs: pd.Series) -> pd.Series:
        codes: dict[str | None, str | None] = {}
        out = []
        for d in docs:
            if d not in codes:
                codes[d] = code(d)
            out.append(codes[d])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, returnType="string")(F.col(doc) if isinstance(doc, str) else doc)


_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?')
_NO_BRACKET = re.compile(r"[^\[\]{}]+")


def nesting(text: str) -> int:
    """The deepest level of brackets outside of strings; works on texts that aren't JSON, too."""
    brackets = _NO_BRACKET.sub("", _STRING.sub("", text))
    return max(accumulate((1 if c in "[{" else -1 for c in brackets), initial=0))
