"""Document sources: JSON and EDN texts, typed rows, malformed input."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

DATA_TYPES = ("json", "edn")

_TOKEN = re.compile(r"""[\s,]+|;[^\n]*|#_|\#\{|[()\[\]{}]|"(?:\\.|[^"\\])*"|\\(?:newline|return|space|tab|formfeed|backspace|u[0-9a-fA-F]{4}|o[0-7]{1,3}|.)|[^\s,()\[\]{}";]+""", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}", "#{": "}"}
_CHARS = {"newline": "\n", "return": "\r", "space": " ", "tab": "\t", "formfeed": "\f", "backspace": "\b"}


def check_data_type(data_type: str) -> str:
    if data_type not in DATA_TYPES:
        raise ValueError(f"unsupported data type {data_type!r}; expected one of {DATA_TYPES}")
    return data_type


def _atom(tok: str):
    if tok[0] == '"':
        return json.loads(tok.replace("\n", "\\n"))
    if tok[0] == "\\":
        if len(tok) > 2 and tok[1] in "uo" and tok[1:] not in _CHARS:
            return chr(int(tok[2:], 16 if tok[1] == "u" else 8))
        return _CHARS.get(tok[1:], tok[1:])
    if tok in ("true", "false", "nil"):
        return {"true": True, "false": False, "nil": None}[tok]
    if re.fullmatch(r"[-+]?\d+[NM]?", tok):
        return int(tok.rstrip("NM"))
    if re.fullmatch(r"[-+]?\d+(\.\d*)?([eE][-+]?\d+)?M?", tok):
        return float(tok.rstrip("M"))
    return tok


def _key(v) -> str:
    if isinstance(v, bool):
        return str(v)
    return "nil" if v is None else v if isinstance(v, str) else str(v)


def edn_to_tagged(text: str):
    """EDN text as JSON-like data: keywords ``":name"``, sets ``{"#set": [...]}``; a tag keeps
    only its value.  Items of a set are sorted by their JSON text."""
    tokens = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad EDN at {at}")
        at = m.end()
        tok = m.group()
        if tok.strip(", \t\r\n") and not tok.startswith(";"):
            tokens.append(tok)
    pos = 0

    def read():
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("unexpected end of EDN")
        tok = tokens[pos]
        pos += 1
        if tok == "#_":
            read()
            return read()
        if tok in _CLOSE:
            items = []
            while pos < len(tokens) and tokens[pos] != _CLOSE[tok]:
                if tokens[pos] == "#_":
                    pos += 1
                    read()
                    continue
                items.append(read())
            if pos >= len(tokens):
                raise ValueError(f"missing {_CLOSE[tok]!r}")
            pos += 1
            if tok == "{":
                if len(items) % 2:
                    raise ValueError("map with an odd number of forms")
                return {_key(k): v for k, v in zip(items[::2], items[1::2])}
            if tok == "#{":
                return {"#set": sorted(items, key=lambda v: json.dumps(v, sort_keys=True))}
            return items
        if tok in (")", "]", "}"):
            raise ValueError(f"unexpected {tok!r}")
        if tok[0] == "#" and len(tok) > 1:
            return read()
        return _atom(tok)

    value = read()
    if pos != len(tokens):
        raise ValueError("more than one form")
    return value


def edn_json(col: Column | str) -> Column:
    """EDN text column rewritten to tagged JSON text; malformed text gives null."""
    @arrow_udf("string")
    def convert(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else json.dumps(edn_to_tagged(t), ensure_ascii=False))
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())
    return convert(F.col(col) if isinstance(col, str) else col)


def parse_documents(df: DataFrame, text: str, data_type: str = "json") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): ``good`` gains ``doc``, the JSON text; bad rows keep their text."""
    check_data_type(data_type)
    doc = F.col(text) if data_type == "json" else edn_json(text)
    parsed = df.withColumn("doc", doc)
    ok = F.try_parse_json("doc").isNotNull()
    return parsed.where(ok), parsed.where(~ok).drop("doc")


def content_id(doc: Column | str) -> Column:
    """Document id from the content, the same on every run."""
    return F.sha2(F.col(doc) if isinstance(doc, str) else doc, 256)


def sets_to_lists(col: Column | str) -> Column:
    """Set-valued array as a sorted list without repeats."""
    return F.array_sort(F.array_distinct(F.col(col) if isinstance(col, str) else col))


def parse_json_value(text: str):
    """One driver-side document; malformed text raises ``ValueError``."""
    return json.loads(text)
