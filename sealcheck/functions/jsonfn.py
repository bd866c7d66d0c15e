"""JSON expressions over raw response text.

Field text comes from a STRING schema, the kind of a field from a VARIANT schema. Parsing would print a number with a
fraction or exponent anew (1.50 as 1.5, 1e2 as 100.0), so `exact_numbers` wraps such literals in text first and the
fields of with_fields and with_members unwrap them, also inside objects and arrays: every scalar keeps its own spelling.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from sealcheck.functions.text import trim_space
from sealcheck.rules import COMPUTED_FIELD_TYPES, COMPUTED_PROPERTY_TYPES


@dataclass(frozen=True)
class RawField:
    """One member of a JSON object: its text, its JSON kind and its JSON encoding."""

    text: Column
    kind: Column
    json: Column

    @property
    def absent(self) -> Column:
        return self.kind == "null"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _struct_of(names: list[str], kind: str) -> str:
    return "struct<" + ",".join(f"{_quoted(n)}:{kind}" for n in names) + ">"


# Stands before a number literal that travels as text. A private character; the text's own ones are doubled meanwhile.
_MARK = "\uE0F1"
_OWN_MARK = rf"(?<!\\)((?:\\\\)*+)(?:{_MARK}|\\u[eE]0[fF]1)"
_BROKEN_NUMBER = r"[0-9](?:\.[0-9]|[eE][+-]?[0-9])"
# \G ties each match to the one before. A match passes over what is no such number: structure, words, whole strings and
# plain integers. Where the text is no JSON the chain breaks and the rest stays as written.
_NEXT_NUMBER = (r'\G((?:[^"0-9-]++|"(?:[^"\\]++|\\.)*+"|-?+[0-9]++(?![0-9.eE]))*+)'
                r'(-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++(?:[eE][+-]?+[0-9]++)?+|[eE][+-]?+[0-9]++))(?=[ \t\r\n,\]}]|$)')


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often it is named; a plain Column is computed wherever it stands."""
    return F.transform(F.array(value), use)[0]


def exact_numbers(document: Column) -> Column:
    """The JSON text with every number that has a fraction or exponent as a marked string of the same spelling.

    One regular expression in the JVM, only for documents that hold such a number at all. Marks of the document's own,
    plain or escaped, are doubled, so that one mark before a digit is always that of a number.
    """
    def doubled(text: Column) -> Column:
        own = (text.contains(_MARK) | text.contains("\\u")) & text.rlike(_OWN_MARK)
        return F.when(own, F.regexp_replace(text, _OWN_MARK, f"$1{_MARK}{_MARK}")).otherwise(text)

    def marked(text: Column) -> Column:
        return F.when(text.rlike(_BROKEN_NUMBER), F.regexp_replace(text, _NEXT_NUMBER, f'$1"{_MARK}$2"')).otherwise(text)

    return _once(document, lambda text: _once(doubled(text), marked))


def _own(text: Column) -> Column:
    return F.when(text.contains(_MARK), F.replace(text, F.lit(_MARK * 2), F.lit(_MARK))).otherwise(text)


def _is_number(text: Column) -> Column:
    return text.startswith(_MARK) & ~text.startswith(_MARK * 2)


def unwrapped(text: Column) -> Column:
    """A parsed text with its numbers as they were written and its own marks single again."""
    def bare(text: Column) -> Column:
        nested = F.regexp_replace(text, f'"{_MARK}([0-9-][^"]*+)"', "$1")
        return F.when(~text.contains(_MARK), text).when(_is_number(text), F.substring(text, 2, F.length(text))).otherwise(_once(nested, _own))

    return _once(text, bare)


def json_items(array: Column) -> Column:
    """The elements of a JSON array as texts, numbers as written; null if the text is no array."""
    return F.transform(F.from_json(exact_numbers(array), "array<string>"), unwrapped)


def _kind(text: Column, variant: Column) -> Column:
    return _once(F.schema_of_variant(variant), lambda schema: (
        F.when(schema.isNull() | (schema == "VOID"), "null").when((schema == "STRING") & _is_number(text), "number")
        .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
        .otherwise("number")))


def _parsed(document: Column, names: list[str]) -> Column:
    """An array of one struct: texts, kinds and variants of the named members of a JSON object, which is made exact and parsed once."""
    def members(text: Column, variant: Column) -> Column:
        return F.struct(F.struct(*[unwrapped(text[n]).alias(n) for n in names]).alias("text"),
                        F.struct(*[_kind(text[n], variant[n]).alias(n) for n in names]).alias("kind"), variant.alias("variant"))

    both = F.transform(F.array(exact_numbers(document)), lambda exact: F.struct(
        F.from_json(exact, _struct_of(names, "string")).alias("text"), F.from_json(exact, _struct_of(names, "variant")).alias("variant")))
    return F.transform(both, lambda one: members(one["text"], one["variant"]))


def _field(text: Column, kind: Column, variant: Column) -> RawField:
    return RawField(text, kind, F.when(kind == "string", _own(F.to_json(variant))).when(kind == "null", "null").otherwise(text))


def with_fields(document: Column, names: list[str], use: Callable[[dict[str, RawField]], Column]) -> Column:
    """`use` of the named members of a JSON object, which is parsed once."""
    return F.transform(_parsed(document, names), lambda one: use(
        {name: _field(one["text"][name], one["kind"][name], one["variant"][name]) for name in names}))[0]


def with_members(frame: DataFrame, document: str, names: list[str], slot: str) -> tuple[DataFrame, dict[str, RawField]]:
    """The named members of a JSON object, parsed once into three struct columns of the frame.

    They come out of a generator of one row, so that no filter on them is moved below it and parses again.
    """
    text, kind, variant = (f"_{slot}_{part}" for part in ("text", "kind", "variant"))
    parsed = frame.select("*", F.inline(_parsed(F.col(document), names)).alias(text, kind, variant))
    return parsed, {name: _field(F.col(text)[name], F.col(kind)[name], F.col(variant)[name]) for name in names}


def stored(field: RawField) -> Column:
    """A member as a column that can be written: its text and kind. `restored` reads it."""
    return F.struct(field.text.alias("text"), field.kind.alias("kind"))


def restored(column: Column) -> RawField:
    text, kind = column["text"], column["kind"]
    # The JSON of a text is that of an array of it, without the brackets.
    quoted = F.to_json(F.array(text))
    return RawField(text, kind, F.when(kind == "string", F.substring(quoted, 2, F.length(quoted) - 2)).when(kind == "null", "null").otherwise(text))


def raw_string(field: RawField) -> Column:
    return F.when(field.kind == "string", field.text)


def raw_scalar(field: RawField) -> Column:
    """A string or number as text, a number in the spelling of its document."""
    return F.when(field.kind.isin("string", "number"), field.text)


def raw_bool(field: RawField) -> Column:
    return F.when(field.kind == "boolean", field.text == "true")


def raw_int(field: RawField) -> Column:
    text = raw_scalar(field)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def raw_double(field: RawField) -> Column:
    text = raw_scalar(field)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def mistyped(field: RawField, value: Column) -> Column:
    """A member that is present but does not have the wanted type; this is a finding, never a silent null."""
    return (field.kind != "null") & value.isNull()


def source_id(field: RawField) -> Column:
    """Id of a source object: non-blank text, or a non-negative integer literal."""
    return (F.when((field.kind == "string") & (trim_space(field.text) != ""), field.text)
            .when((field.kind == "number") & ~field.text.rlike("[.eE-]"), field.text))


def status_fields(field: RawField) -> tuple[Column, Column]:
    """(status, status_type) of a nested status object."""
    both = with_fields(F.when(field.kind == "object", field.text), ["status", "type"], lambda members: F.struct(
        raw_string(members["status"]).alias("status"), raw_string(members["type"]).alias("type")))
    return both["status"], both["type"]


def priority_field(field: RawField) -> Column:
    return with_fields(F.when(field.kind == "object", field.text), ["priority"], lambda members: raw_scalar(members["priority"]))


def rich_text(document: Column) -> Column:
    """Text of a rich-text value: a JSON string as itself, an array of text parts joined, anything else null."""
    bare = trim_space(document)
    parts = F.from_json(bare, "array<struct<text:string,plain_text:string>>")
    joined = F.array_join(F.transform(parts, lambda part: F.coalesce(part["plain_text"], part["text"], F.lit(""))), "")
    quoted = F.from_json(F.concat(F.lit('{"v":'), bare, F.lit("}")), "struct<v:string>")["v"]
    return F.when(bare.startswith('"'), quoted).when(bare.startswith("["), joined)


def typed_title(properties: Column) -> Column:
    """Text of the property whose type is `title`, whatever the property is called."""
    values = F.map_values(F.from_json(properties, "map<string,string>"))
    parsed = F.transform(values, lambda v: F.from_json(v, "struct<type:string,title:string>"))
    titles = F.transform(F.filter(parsed, lambda p: p["type"] == "title"), lambda p: trim_space(rich_text(p["title"])))
    return F.try_element_at(F.filter(titles, lambda t: t.isNotNull() & (t != "")), F.lit(1))


def block_text(block: Column, block_type: Column) -> Column:
    """Text nested under a block's own type name: rich text, else caption."""
    body = F.try_element_at(F.from_json(block, "map<string,string>"), block_type)
    parts = F.from_json(body, "struct<rich_text:string,caption:string>")
    return F.coalesce(F.nullif(trim_space(rich_text(parts["rich_text"])), F.lit("")),
                      F.nullif(trim_space(rich_text(parts["caption"])), F.lit("")))


def field_semantics_state(field_type: Column, computed=tuple(COMPUTED_FIELD_TYPES)) -> Column:
    """Computed source fields are observed, never executed."""
    return F.when(F.lower(field_type).isin(list(computed)), "OBSERVED_ONLY_NO_EXECUTION").otherwise(
        "SOURCE_DEFINITION_ONLY")


PROPERTY_TYPES = tuple(COMPUTED_PROPERTY_TYPES)


class _Literal(str):
    """A number kept exactly as written."""


class _Refused(ValueError):
    """JSON that is no JSON: NaN, Infinity or -Infinity."""


_BAD = object()
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|(-?Infinity|NaN))')


_DECODER = json.JSONDecoder(parse_int=_Literal, parse_float=_Literal, parse_constant=lambda name: _BAD)
_ESCAPED = re.compile(r'[\x00-\x1f"\\<>&]')


def _parse(text: str):
    """The value of a JSON text with number literals kept; a refused constant becomes a mark inside the value."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """As _parse with a list of open values instead of recursion, for any depth."""
    at, stack, key, state, root = 0, [], None, "value", None
    while match := _TOKEN.match(text, at):
        at, (mark, string, number, word, bad) = match.end(), match.groups()
        if mark in ("}", "]"):
            if not stack or state not in ("next", "first") or (mark == "}") != isinstance(stack[-1][0], dict):
                raise ValueError(text[at:at + 20])
            key = stack.pop()[1]
            state = "next" if stack else "end"
        elif mark in (",", ":"):
            if mark == "," and state == "next" and stack:
                state = "key" if isinstance(stack[-1][0], dict) else "value"
            elif mark == ":" and state == "colon":
                state = "value"
            else:
                raise ValueError(mark)
        elif state in ("key", "first") and stack and isinstance(stack[-1][0], dict):
            if not string:
                raise ValueError("key")
            key, state = json.loads(string, strict=True), "colon"
        elif state in ("value", "first"):
            value = ({} if mark == "{" else [] if mark == "[" else json.loads(string) if string else _Literal(number) if number
                     else _BAD if bad else {"true": True, "false": False, "null": None}[word])
            if not stack:
                root = value
            elif isinstance(stack[-1][0], dict):
                stack[-1][0][key] = value
            else:
                stack[-1][0].append(value)
            if mark:
                stack.append((value, key))
                state = "first"
            else:
                state = "next" if stack else "end"
        else:
            raise ValueError(match[0])
    if state != "end" or text[at:].strip(" \t\n\r"):
        raise ValueError(text[at:at + 20])
    return root


def _quote(value: str) -> str:
    if value.isascii() and not _ESCAPED.search(value):
        return f'"{value}"'
    text = json.dumps(value.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), ensure_ascii=False)
    for char in "<>&\u2028\u2029":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return text


def _encode(value) -> str:
    """Canonical text, written piece by piece from a list of what is still to write, for any depth."""
    out, todo = [], [value]
    while todo:
        item = todo.pop()
        if isinstance(item, tuple):
            out.append(item[0])
        elif item is None or item is True or item is False:
            out.append({None: "null", True: "true", False: "false"}[item])
        elif item is _BAD:
            raise _Refused
        elif isinstance(item, _Literal):
            out.append(str(item))
        elif isinstance(item, str):
            out.append(_quote(item))
        elif isinstance(item, list):
            todo.append(("]",))
            for n in range(len(item) - 1, -1, -1):
                todo += [item[n], (",",)] if n else [item[n]]
            out.append("[")
        else:
            todo.append(("}",))
            names = sorted(item)
            for n in range(len(names) - 1, -1, -1):
                todo += [item[names[n]], ((("," if n else "") + _quote(names[n]) + ":"),)]
            out.append("{")
    return "".join(out)


def _canonical(text):
    if text is None:
        return None
    try:
        return _encode(_parse(text))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(documents: pd.Series) -> pd.Series:
    """JSON with sorted keys, number literals as written. Null when the text is not valid JSON.

    Arrow batches, one pass per value: no built-in expression keeps number literals and refuses trailing text.
    """
    return documents.map(_canonical, na_action="ignore")


def _member(text, name):
    if text is None:
        return None
    try:
        parsed = _parse(text)
        return _encode(parsed[name]) if isinstance(parsed, dict) and name in parsed else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_member(documents: pd.Series, names: pd.Series) -> pd.Series:
    """Canonical JSON of one member of an object. Null when absent; an explicit null gives the text `null`."""
    return pd.Series([_member(text, name) for text, name in zip(documents, names)], dtype="object")


def _override(text, members):
    if text is None or members is None:
        return None
    try:
        both = [_parse(text), _parse(members)]
        return _encode(both[0] | both[1]) if all(isinstance(x, dict) for x in both) else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_override(documents: pd.Series, members: pd.Series) -> pd.Series:
    """Canonical JSON of an object with some members replaced by those of a second object."""
    return pd.Series([_override(text, other) for text, other in zip(documents, members)], dtype="object")


def _list(parsed, name):
    """Canonical elements of an array member, null where one is no JSON; null if there is no such array."""
    items = parsed.get(name) if isinstance(parsed, dict) else None
    if not isinstance(items, list):
        return None
    out = []
    for item in items:
        try:
            out.append(_encode(item))
        except _Refused:
            out.append(None)
    return out


def _elements(text, name):
    """(whether the text is JSON, elements of the member)."""
    try:
        return (False, None) if text is None else (True, _list(_parse(text), name))
    except ValueError:
        return False, None


def _arrays(text, names):
    """Elements of several members of one document, which is parsed once."""
    try:
        parsed = None if text is None else _parse(text)
    except ValueError:
        parsed = None
    return [_list(parsed, name) for name in names]


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def canonical_arrays(documents: pd.Series, names: pd.Series) -> pd.Series:
    """As the items of canonical_elements, for several array members at once, in the order of `names`."""
    return pd.Series([_arrays(text, wanted) for text, wanted in zip(documents, names)], dtype="object")


@F.pandas_udf(StructType().add("readable", BooleanType()).add("items", ArrayType(StringType())))
def canonical_elements(documents: pd.Series, names: pd.Series) -> pd.DataFrame:
    """(readable, items): canonical JSON of every element of one array member.

    readable says whether the document is JSON at all; items is null when the member is absent or no array. An
    element that holds NaN or an infinity is a null item, whatever the others are.
    """
    return pd.DataFrame([_elements(text, name) for text, name in zip(documents, names)], columns=["readable", "items"])


def valid_json(document: Column) -> Column:
    """Whether a text is one JSON value.

    Built-in parsing settles nearly all: what reads as the only element of an array and as the only member of an
    object is one value. It refuses values nested deeper than a thousand levels, so only what it refuses is
    settled in Python.
    """
    plain = F.coalesce((F.json_array_length(F.concat(F.lit("["), document, F.lit("]"))) == 1)
                       & F.try_parse_json(F.concat(F.lit('{"v":'), document, F.lit("}"))).isNotNull(), F.lit(False))
    return plain | canonical_json(F.when(~plain, document)).isNotNull()
