"""Secrets in texts: a keyword automaton first, anchored expressions near its hits, checksums last."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _text

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "checked")

#: The words before an assigned secret, the prefix of an access key, and the prefixes of
#: tokens that end in a checksum (30 characters and the CRC-32 of the part before, in base 62).
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: A run of hexadecimal digits has no keyword; a run of this many covers every 24th place of a text.
HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[int, int, str]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_PREFIX,)), ("checked", CHECKED_PREFIXES)):
        for w in words:
            found.add_word(w.lower(), (kind, len(w)))
    found.make_automaton()
    return found


def crc_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those between prefix and checksum."""
    body, told = token[4:-6], token[-6:]
    rest, n = "", zlib.crc32(body.encode())
    while n:
        n, d = divmod(n, 62)
        rest = BASE62[d] + rest
    return rest.rjust(6, "0") == told


def find(text: str) -> list[Span]:
    """All ``(start, end, kind)`` of a text in code points, by start, then kind. Matches of one kind
    don't overlap: the leftmost counts, and what it covers is used up even if it fails its test."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out: list[Span] = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    used = dict.fromkeys(KINDS, 0)
    for start, kind in sorted((last - n + 1, kind) for last, (kind, n) in _automaton().iter(low)):
        if start < used[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                used[kind] = m.end()
                if m.end(2) - m.start(2) >= 6:
                    out.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                used[kind] = m.end()
                if m.end() - start >= 20:
                    out.append((start, m.end(), kind))
        elif (m := CHECKED.match(text, start)) and crc_holds(m[0]):
            used[kind] = m.end()
            out.append((start, m.end(), kind))
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans array<struct<start, end, kind>>)`` for every whole text of ``docs (doc_id,
    text)``: assigned secrets, access keys, long hexadecimal runs, and tokens whose embedded checksum
    holds. Null and empty texts have no spans; repeated rows give a row each; other columns are
    ignored. A text of any length is scanned in linear time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in _text.chunks(batches):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {doc}, spans array<struct<start:long,end:long,kind:string>>")
