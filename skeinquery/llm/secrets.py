"""Secrets in whole texts: an Aho-Corasick pass finds keywords, anchored patterns run at the hits only, and kinds with
an embedded checksum count only where it holds.

Kinds without a checksum: `assign` (a keyword, an equals sign or colon, a value of 8+ characters), `access` (an
access-key id of 16+ characters), `hex` (32+ hex digits). Kinds with one: `github` and `npm` tokens, whose last six
characters are the CRC-32 of the thirty before them in base 62.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skeinquery.llm.common import decoded, emitted, pairs, text_bytes, texts

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def base62_crc(body: str) -> str:
    """The CRC-32 of an ASCII text as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(6, "0")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find_secrets(text: str, auto) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the order of KINDS; offsets in code points, end exclusive.

    Per kind, matches are leftmost and do not overlap: a match that fails its length or checksum still uses up its text.
    """
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: offsets stay
    hits = sorted((end - size + 1, kind) for end, (kind, size) in auto.iter(folded))
    done, found = dict.fromkeys(KINDS, 0), []
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= 8
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and m.end() - start >= 16
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            good = m and base62_crc(m[1]) == m[2]
        if m:
            done[kind] = m.end()
        if good:
            found.append((start, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, text): counts by kind, the digest of the base spans, and all spans.

    Narrow: no shuffle, a text at a time. Null and empty texts have no span; repeated rows and null ids keep a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, raw in pairs(batch, "doc_id", "text"):
                    spans = find_secrets(decoded(raw), auto)
                    counts = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                    base = joined([x for x in spans if x[2] in BASE])
                    yield doc, *counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans)

        return emitted(SCHEMA, rows())

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return texts(docs).mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string")


def redact(text: str, auto, mark: str = "[SECRET]") -> str:
    """The text with each secret replaced; overlapping spans become one."""
    out, at = [], 0
    for start, end, _ in find_secrets(text, auto):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; `text` without its secrets, and `n_chars`, where there is one, counted anew. Null stays null, and texts without secrets keep every byte."""
    fields = docs.schema
    text_at, chars_at = fields.names.index("text"), fields.names.index("n_chars") if "n_chars" in fields.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                old, field = text_bytes(part), part.schema.field(text_at)
                new = [t if t is None or not find_secrets(decoded(t), auto) else redact(decoded(t), auto, mark).encode() for t in old]
                part = part.set_column(text_at, field, pa.array(new, pa.large_binary() if pa.types.is_large_string(field.type) else pa.binary()).view(field.type))
                if chars_at is not None:
                    counts = [c if a == b else len(decoded(b)) for c, a, b in zip(part.column(chars_at).to_pylist(), old, new, strict=True)]
                    part = part.set_column(chars_at, part.schema.field(chars_at), pa.array(counts, part.schema.field(chars_at).type))
                yield part

    return docs.mapInArrow(run, fields)
