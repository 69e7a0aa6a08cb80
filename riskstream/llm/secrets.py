"""Secret scans: a keyword automaton first, anchored expressions near its hits, checksums last.

One Aho-Corasick pass over the text in lower case finds where a secret of some kind may begin; only there the expression of
that kind is matched, anchored at the hit. Runs of hex digits have no keyword of their own: for them the text's bytes are
mapped to classes and a run of 24 digits is the keyword. Token kinds that embed a checksum are kept if it holds.

The result is a string of ``kind:start:end`` spans in code points, end exclusive, by start and then in the order of
``KINDS``. Matches of a kind don't overlap: the leftmost is taken, and one that fails its kind's length is dropped with
all it covers. Spans of different kinds may overlap. A null text counts as empty and has no spans; ``redacted`` leaves it
null, and other columns, repeated rows and empty tables as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import given_back, ship_package

# Keywords, expressions and least lengths of the kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(rb"[0-9a-f]+")
HEX_LEAST = 24
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

BASE_KINDS = KINDS[:3]
REPLACEMENT = "[SECRET]"
_HEX_CLASS = bytes(ord("x") if chr(i) in "0123456789abcdef" else (0 if chr(i) == "x" else i) for i in range(256))
_STATE: dict = {}


def checksum(body: str) -> str:
    """The six base62 digits of a body's CRC-32, as tokens of the two checked kinds end with."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _automaton():
    if "ac" not in _STATE:
        import ahocorasick

        ac = ahocorasick.Automaton()
        words = [(w, "assign") for w in ASSIGN_WORDS] + [("akia", "access"), ("npm_", "npm")]
        for w, kind in words + [(w, "github") for w in GITHUB_WORDS]:
            ac.add_word(w, (kind, len(w) - 1))
        ac.make_automaton()
        _STATE["ac"] = ac
    return _STATE["ac"]


def _assign_ok(m: re.Match) -> bool:
    return len(m[2]) >= ASSIGN_LEAST


def _access_ok(m: re.Match) -> bool:
    return len(m[0]) >= ACCESS_LEAST


def _checksum_ok(m: re.Match) -> bool:
    return checksum(m[1]) == m[2]


_NEAR = {"assign": (ASSIGN, _assign_ok), "access": (ACCESS, _access_ok), "github": (GITHUB, _checksum_ok),
         "npm": (NPM, _checksum_ok)}


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret, sorted."""
    plain = text.isascii()
    raw = text.encode()
    low = text.lower() if plain else raw.lower().decode()  # bytes have A-Z lowered only, so places stay
    found, done = [], {}
    hits = sorted((end - back, kind) for end, (kind, back) in _automaton().iter(low))
    for start, kind in hits:
        if start < done.get(kind, 0):
            continue
        pattern, ok = _NEAR[kind]
        m = pattern.match(text, start)
        if m:
            done[kind] = m.end()
            if ok(m):
                found.append((start, KINDS.index(kind), m.end()))
    classes, run, at, chars = raw.translate(_HEX_CLASS), b"x" * HEX_LEAST, 0, 0
    while (start := classes.find(run, at)) >= 0:
        end = HEX.match(raw, start).end()
        chars += start - at if plain else len(raw[at:start].decode())
        found.append((chars, KINDS.index("hex"), chars + end - start))
        chars, at = chars + end - start, end
    return sorted(found)


def _spans(text: str | None) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in find(text)) if text else ""


def _redact(text: str | None) -> str | None:
    if not text or not (found := find(text)):
        return text
    out, at = [], 0
    for a, _, z in found:
        if a >= at:
            out += [text[at:a], REPLACEMENT]
        at = max(at, z)
    return "".join(out) + text[at:]


def _on_series(f):
    def work(batches):
        for texts in batches:
            yield pd.Series([f(t) for t in texts], dtype=object)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return given_back(work)(batches)

    return F.pandas_udf(each, "string")


def spans(text: Column) -> Column:
    return _on_series(_spans)(text)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each document."""
    ship_package(docs.sparkSession)
    d = docs.select("doc_id", spans(F.col("text")).alias("spans"))
    base = F.filter(F.split("spans", ","), lambda s: F.substring_index(s, ":", 1).isin(*BASE_KINDS))
    counts = [F.expr(f"size(filter(base, s -> startswith(s, '{k}:')))").cast("long").alias(f"n_{k}")
              for k in BASE_KINDS]
    return d.withColumn("base", base).select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256)
                                             .alias("base_sha256"), "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced; n_chars, if there, follows the texts that change."""
    ship_package(docs.sparkSession)
    out = docs.withColumn("text", F.struct(F.col("text").alias("was"), _on_series(_redact)(F.col("text")).alias("now")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text.was") != F.col("text.now"), F.length("text.now"))
                             .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("text.now")).select(*docs.columns)
