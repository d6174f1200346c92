"""Text expressions: redaction, normalisation, fingerprints, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILTERED = "[FILTERED]"
# The patterns and their order decide what is redacted or normalised.
SCRUB = (
    r"\b(?:\d[ -]*?){13,19}\b",
    r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b",
    r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
)
NORMAL = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b", "<IP>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (r"/[a-zA-Z0-9_-]+/[0-9]+", "/<PATH>/<N>"),
    (r"\b\d{2,}\b", "<N>"),
    (r'"[^"]{4,}"', "<STR>"),
    (r"'[^']{4,}'", "<STR>"),
)
MASK = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*", "*"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "*"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "*"),
    (r'"[^"]*"', '"*"'),
    (r"\b\d+\b", "*"),
)


def chain(c: Column, steps) -> Column:
    for pattern, put in steps:
        c = F.regexp_replace(c, pattern, put)
    return c


def byte_prefix(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters within `limit` bytes."""
    raw = c.cast("binary")
    # A cut inside a character is not valid; at most three of its bytes can be left.
    tries = [F.try_validate_utf8(F.substring(raw, 1, limit - i).cast("string")) for i in range(4)]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*tries))


def scrub_text(c: Column) -> Column:
    """ING-2: cards, e-mails, phones and social-security numbers, in that order."""
    return chain(c, [(p, FILTERED) for p in SCRUB])


def normalize_message(c: Column) -> Column:
    """ING-5: what varies between occurrences of one error becomes a placeholder."""
    return F.trim(chain(byte_prefix(c, 500), NORMAL))


def mask_message(c: Column) -> Column:
    """The coarser normaliser of AGG-13: variable parts become a star."""
    return chain(c, MASK)


def fingerprint(service: Column, error_class: Column, source_file: Column, message: Column) -> Column:
    """ING-4: md5 of service, class and file, or the normalised message without a file; 16 digits."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    nul = F.lit("\0")
    last = F.coalesce(F.nullif(source_file, F.lit("")), normalize_message(empty(message)))
    made = F.substring(F.md5(F.concat(empty(service), nul, empty(error_class), nul, last)), 1, 16)
    return F.when((empty(error_class) == "") & (empty(source_file) == ""), "").otherwise(made)


def tokens(c: Column) -> Column:
    """FLT-5: distinct lower-cased runs of letters, digits, _ and - of two bytes and more."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}_-]+"), lambda t: F.octet_length(t) >= 2))


# The same in SQL, for twins and for `expr`.
def sql_chain(c: str, steps) -> str:
    for pattern, put in steps:
        c = "regexp_replace({}, '{}', '{}', 'g')".format(c, pattern.replace("'", "''"), put.replace("'", "''"))
    return c


def sql_scrub(c: str) -> str:
    return sql_chain(c, [(p, FILTERED) for p in SCRUB])


def sql_byte_prefix(c: str, limit: int) -> str:
    return f"CASE WHEN strlen({c}) <= {limit} THEN {c} ELSE left({c}, list_max(list_filter(range(0, {limit} + 1), lambda upto: strlen(left({c}, upto)) <= {limit}))) END"


def sql_normalize(c: str) -> str:
    return f"trim({sql_chain(sql_byte_prefix(c, 500), NORMAL)})"


def sql_mask(c: str) -> str:
    return sql_chain(c, MASK)


def sql_fingerprint(service: str, cls: str, file: str, message: str) -> str:
    return (
        f"CASE WHEN coalesce({cls},'')='' AND coalesce({file},'')='' THEN '' ELSE "
        f"left(md5(coalesce({service},'')||chr(0)||coalesce({cls},'')||chr(0)||coalesce(nullif({file},''),{sql_normalize(message)})),16) END"
    )


def sql_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{Nd}}_-]+'), lambda t: strlen(t) >= 2))"
