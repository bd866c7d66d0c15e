"""Text, path and Markdown expressions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from sealcheck.functions.ids import DEFAULT_PREFIX
from sealcheck.rules import MAX_TEXT, RESERVED_NAMES

SPACE = r"\p{IsWhite_Space}"
COMPONENT_BYTES = 96
SUFFIX_CHARS = 16


def let(value: Column, body) -> Column:
    """Bind an expression once inside `body`, so that large expressions are not repeated in generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\P{IsWhite_Space}"), F.lit(True))


def or_else(text: Column, fallback: Column) -> Column:
    """The text unless it is null or blank."""
    return F.when(is_blank(text), fallback).otherwise(text)


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f\x7f]")


def bad_text(text: Column, limit: int, allow_empty: bool = False) -> Column:
    """Whether a text field breaks its bounds: blank, over `limit` bytes, invalid UTF-8 or a control character."""
    broken = (F.octet_length(text) > limit) | has_control(text) | ~F.is_valid_utf8(text)
    blank = F.lit(False) if allow_empty else is_blank(text)
    return blank | F.coalesce(broken, F.lit(False))


def cut_bytes(text: Column, limit) -> Column:
    """Longest prefix of at most `limit` bytes that does not split a character."""
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def cut(value):
        tries = [F.try_validate_utf8(F.substring(value.cast("binary"), F.lit(1), limit - back).cast("string")) for back in range(4)]
        return F.when(F.octet_length(value) <= limit, value).otherwise(F.coalesce(*tries, F.lit("")))

    return let(text, cut)


def clean_path(path: Column) -> Column:
    """Collapse repeated and trailing separators and `.` segments of a path."""
    collapsed = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(?<=/)\.(?:/|$)", "")
    return F.when(F.length(collapsed) > 1, F.regexp_replace(collapsed, "/+$", "")).otherwise(collapsed)


def escapes_root(path: Column) -> Column:
    """Whether a relative path is empty, absolute or climbs above its root."""
    depth = F.aggregate(
        F.filter(F.split(path, "/"), lambda part: ~part.isin("", ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda state, part: F.struct(
            (state["at"] + F.when(part == "..", -1).otherwise(1)).alias("at"),
            F.least(state["low"], state["at"] + F.when(part == "..", -1).otherwise(1)).alias("low")))
    return (F.coalesce(path, F.lit("")) == "") | path.startswith("/") | (depth["low"] < 0) | (
        path.rlike(r"^(\./*)+$")) | ((depth["at"] == 0) & path.contains(".."))


def strip_url_query(url: Column) -> Column:
    """Drop query and fragment. Null when the URL cannot be parsed or nothing is left."""
    before_query = F.regexp_replace(url, r"(?s)[?#].*$", "")
    broken = has_control(url) | url.startswith(":") | before_query.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~broken, F.nullif(before_query, F.lit("")))


def _plain_name(name: Column) -> Column:
    masked = F.regexp_replace(trim_space(name), r'[\p{Cc}<>:"/\\|?*]', "_")
    return F.regexp_replace(F.regexp_replace(masked, f"{SPACE}+", " "), r"^[ .]+|[ .]+$", "")


def id_suffix(portable: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """First characters of an id in a form safe for any file system."""
    def suffix(bare):
        safe = F.when(bare.rlike("^[0-9A-Za-z]+$"), F.lower(bare)).otherwise(F.concat(F.lit("id"), F.sha2(bare, 256)))
        return F.when(bare == "", F.lit("unknown")).otherwise(F.substring(safe, 1, SUFFIX_CHARS))

    return let(F.regexp_replace(trim_space(portable), "^" + prefix, ""), suffix)


def _named(plain: Column, suffix: Column) -> Column:
    """A cleaned name cut to its budget, or a stand-in, with a mark if the name is reserved."""
    def marked(name):
        reserved = F.upper(F.regexp_replace(name, r"\.[^.]*$", "")).isin(RESERVED_NAMES)
        return F.concat(F.when(reserved, F.lit("_")).otherwise(F.lit("")), name)

    cut = F.regexp_replace(cut_bytes(plain, COMPONENT_BYTES - F.octet_length(suffix) - 2), "[ .]+$", "")
    return let(F.coalesce(F.nullif(cut, F.lit("")), F.lit("unnamed")), marked)


def safe_component(name: Column, portable: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """One path component: readable name, bounded in bytes, made unique by the id."""
    return let(id_suffix(portable, prefix), lambda suffix: F.concat(_named(_plain_name(name), suffix), F.lit("--"), suffix))


def attachment_component(filename: Column, portable: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """As safe_component, keeping a file extension of up to 16 bytes."""
    def split(name):
        extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
        stem = safe_component(F.regexp_replace(name, r"\.[^.]*$", ""), portable, prefix)
        return F.concat(stem, F.when(F.octet_length(extension) > 16, F.lit("")).otherwise(extension))

    return let(F.coalesce(_plain_name(filename), F.lit("")), split)


def plural_kind(kind: Column) -> Column:
    name = _plain_name(F.lower(kind))
    return F.concat(F.when((name == "") | (name == "unnamed"), F.lit("container")).otherwise(name), F.lit("s"))


def safe_text(text: Column, limit: int = MAX_TEXT) -> Column:
    """Text safe to store and show: no control characters, valid UTF-8, trimmed and byte-bounded."""
    valid = F.when(F.is_valid_utf8(text), text).otherwise(
        F.regexp_replace(F.make_valid_utf8(text), "�", ""))
    clean = trim_space(F.regexp_replace(valid, r"[\x00-\x1f\x7f]", " "))
    return F.when(F.octet_length(clean) <= limit, clean).otherwise(
        F.concat(cut_bytes(clean, limit - 3), F.lit("...")))


def redact(text: Column, secrets: Sequence[str]) -> Column:
    """Mask every configured secret and neutralise control characters other than tab."""
    masked = reduce(lambda value, secret: F.replace(value, F.lit(secret), F.lit("[REDACTED]")), secrets, text)
    return trim_space(F.regexp_replace(masked, r"[\x00-\x08\x0a-\x1f]", " "))


def contains_secret(columns: Sequence[Column], secrets: Sequence[str]) -> Column:
    """Whether any of the text or binary columns holds a configured secret."""
    hits = [F.coalesce(F.contains(column, F.lit(secret).cast("binary") if binary else F.lit(secret)), F.lit(False))
            for column, binary in ((c if isinstance(c, tuple) else (c, False)) for c in columns)
            for secret in secrets if secret]
    return reduce(lambda left, right: left | right, hits, F.lit(False))


def inline_markdown(text: Column) -> Column:
    """Escape Markdown-significant characters and fold line breaks."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("`", "&#96;"), ("\r", " "), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def code_block(text: Column) -> Column:
    """Indented block; every line ends with a line feed."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.concat(F.lit("    "), F.replace(lines, F.lit("\n"), F.lit("\n    ")), F.lit("\n"))


def safe_extension(filename: Column) -> Column:
    """Lower-cased extension of 2 to 12 characters, letters and digits only, else empty."""
    return F.coalesce(F.regexp_extract(F.lower(filename), r"(\.[a-z0-9]{1,11})$", 1), F.lit(""))
