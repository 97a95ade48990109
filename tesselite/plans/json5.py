"""JSON5 documents: JSON with comments, trailing commas, bare keys, single quotes and free numbers."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|\d*\.?\d+(?:[eE][+-]?\d+)?\.?))|(?P<name>[A-Za-z_$][\w$-]*)|(?P<op>[{}\[\]:,])""", re.S)


def _text(raw: str) -> str:
    body = re.sub(r"\\\r?\n", "", raw[1:-1])
    body = re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", body)
    body = re.sub(r"\\(['0v])", lambda m: {"'": "'", "0": "\\u0000", "v": "\\u000b"}[m[1]], body)
    if raw[0] == "'":
        body = re.sub(r'(?<!\\)"', r"\"", body)
    return json.loads(f'"{body}"', strict=False)


def loads(text: str):
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable JSON5 at line {text.count(chr(10), 0, at) + 1}: {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0], at))
        at = m.end()
    k = 0

    def fail():
        where = tokens[k][2] if k < len(tokens) else len(text)
        raise ValueError(f"unexpected JSON5 at line {text.count(chr(10), 0, where) + 1}")

    def value():
        nonlocal k
        if k >= len(tokens):
            fail()
        kind, raw, _ = tokens[k]
        k += 1
        if kind == "str":
            return _text(raw)
        if kind == "num":
            if raw.lstrip("+-").lower().startswith("0x"):
                return int(raw, 16)
            return int(raw) if re.fullmatch(r"[+-]?\d+", raw) else float(raw.rstrip(".").replace("Infinity", "inf"))
        if kind == "name":
            if raw in ("true", "false", "null"):
                return {"true": True, "false": False, "null": None}[raw]
            if raw in ("Infinity", "NaN"):
                return float(raw.replace("Infinity", "inf"))
        if raw == "[":
            out = []
            while k < len(tokens) and tokens[k][1] != "]":
                out.append(value())
                if k < len(tokens) and tokens[k][1] == ",":
                    k += 1
            if k >= len(tokens):
                fail()
            k += 1
            return out
        if raw == "{":
            out = {}
            while k < len(tokens) and tokens[k][1] != "}":
                key = tokens[k]
                if key[0] not in ("str", "name", "num") or tokens[k + 1][1] != ":":
                    fail()
                k += 2
                out[_text(key[1]) if key[0] == "str" else key[1]] = value()
                if k < len(tokens) and tokens[k][1] == ",":
                    k += 1
            if k >= len(tokens):
                fail()
            k += 1
            return out
        k -= 1
        fail()

    out = value()
    if k != len(tokens):
        fail()
    return out
