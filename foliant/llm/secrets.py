"""Operator 7, secret scan: keyword automaton, anchored expressions at its hits, embedded checksums.

An Aho-Corasick automaton finds all keywords of a text in one pass; each expression is tried only where its keyword stands.
Kinds that carry a checksum or a structure are then checked by it:

- github: `ghp_ gho_ ghu_ ghs_ ghr_`, 30 characters and the CRC-32 of them in 6 base-62 digits
- npm: `npm_`, likewise
- jwt: `eyJ...`, three base64url parts of which the first two decode to JSON objects
- pem: a private-key block whose labels agree and whose body is base64

The base kinds assign, access and hex follow the contract; hex has no keyword and is found as runs.

Defined results: a null text counts as empty and gives no spans; a null id is scanned as any other; repeated rows each give
a row; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import arrow_map, table

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
EXPRESSIONS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"(npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{16,})"),
    "pem": re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"),
}
HEX = re.compile(r"[0-9a-f]{24,}")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def base62(value: int, width: int) -> str:
    out = ""
    for _ in range(width):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        return base62(zlib.crc32(m[2].encode()), 6) == m[3]
    if kind == "jwt":
        return _json_part(m[1]) and _json_part(m[2])
    body = "".join(m[2].split())
    return len(body) >= 32 and len(body) % 4 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def spans(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two
        low = text.translate(_ASCII_LOWER)
    found, over = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (n, kind) in keywords.iter(low))
    for start, kind in hits:
        if start >= over[kind] and (m := EXPRESSIONS[kind].match(text, start)):
            over[kind] = m.end()
            if valid(kind, m):
                found.append((start, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans."""

    def make():
        keywords = automaton()

        def f(batch):
            out = {"doc_id": batch.column(0).to_pylist()} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
            for text in batch.column(1).to_pylist():
                found = spans(text or "", keywords)
                base = [s for s in found if s[2] in BASE]
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
            return out

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", text_col)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
SQL: dict[str, str] = {}
