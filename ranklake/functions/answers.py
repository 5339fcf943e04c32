"""What language models answer: lists of domains, JSON in wrappings."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def legacy_domains(output: Column) -> Column:
    """Domains of an answer's lines by the older rules: a bullet and a leading number go, a domain is the last two labels
    of what is left, and each counts once."""
    lines = F.filter(F.transform(F.split(F.trim(output), r"\n"), F.trim), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^(?:[-*] )+", ""))
    bare = F.transform(bare, lambda x: F.trim(F.regexp_replace(x, r"^(?:\d(?:\d?\.)|\d[^)]*\))", "")))
    host = F.transform(bare, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?i)^[a-z]+://", ""), r"[/?#:\s].*$", "")))
    named = F.filter(host, lambda x: x.rlike(r"^[^.\s]+(\.[^.\s]+)+$"))
    return F.array_distinct(F.transform(named, lambda x: F.substring_index(x, ".", -2)))


_TEXT = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_LIST = re.compile(r'"prompt_templates"\s*:\s*(?=\[)')


def _inside(raw: str, start: int) -> str | None:
    """What stands between the bracket at start and the one that closes it, brackets in texts not counting."""
    open_, at = 0, start
    while at < len(raw):
        text = _TEXT.match(raw, at)
        if text:
            at = text.end()
            continue
        open_ += (raw[at] == "[") - (raw[at] == "]")
        if not open_:
            return raw[start + 1 : at]
        at += 1
    return None


def load_json(raw: str | None) -> object:
    """The JSON value of an answer: all of it, else the first object in it that can be read, else the texts of a list of
    prompt templates whose list is broken. Raises ValueError where there is none."""
    raw = (raw or "").strip()
    try:
        return json.loads(raw)
    except ValueError:
        pass
    reader = json.JSONDecoder()
    at = raw.find("{")
    while at >= 0:
        try:
            return reader.raw_decode(raw, at)[0]
        except ValueError:
            at = raw.find("{", at + 1)
    found = _LIST.search(raw)
    body = _inside(raw, found.end()) if found else None
    texts = [json.loads(x) for x in _TEXT.findall(body)] if body else []
    if not texts:
        raise ValueError("no JSON in the answer")
    return {"prompt_templates": texts}


def recovered_json(output: Column) -> Column:
    """``load_json`` as compact JSON with sorted keys; null where there is none. Arrow batches carry the answers."""

    def recover(values):
        def one(x: str | None) -> str | None:
            try:
                return json.dumps(load_json(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(one)

    return F.pandas_udf(recover, "string")(output)
