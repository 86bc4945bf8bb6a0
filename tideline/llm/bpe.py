"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _text

#: Pieces whose ids a worker keeps; when full, the memory starts anew.
MEMORY = 150_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1,
    else the next unused one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in own:
        out[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        out[b] = chr(0x100 + i)
    return out


class Codec:
    """Encodes to and decodes from the ids of a file of ranks (base64 bytes and rank a line).

    Any two neighbours whose joint bytes have a rank may merge, lowest rank first, as in the rank
    file's own library: so the merge list holds every split of a token into two tokens. A piece that
    is a token as a whole is that token.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        to = byte_characters()
        name = {t: "".join(map(to.__getitem__, t)) for t in ranks}
        #: The token of each rank in the characters that stand for bytes, and its bytes' number.
        self.token = [""] * (max(ranks.values()) + 1)
        for t, rank in ranks.items():
            self.token[rank] = name[t]
        self.size = np.array([len(t) for t in self.token], np.int64)
        #: The byte that each such character stands for.
        self.back = np.zeros(1 << 10, np.uint8)
        self.back[[ord(c) for c in to]] = np.arange(256)
        merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.whole = Tokenizer(model)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.piece = Tokenizer(model)
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers: a list of Python's takes four times the memory
        self.told: dict[str, str] = {}

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them known from then on. Each distinct piece goes through
        the library once; its ids are kept, as most of any text is pieces seen before."""
        found = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(found)).difference(self.known))
        if new:
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
                self.told.clear()
                new = list(set(chain.from_iterable(found)))
            for at in range(0, len(new), 8192):
                part = new[at : at + 8192]
                for p, e in zip(part, self.piece.encode_batch_fast(part, add_special_tokens=False)):
                    ids = e.ids
                    self.known[p] = array("i", ids).tobytes()
                    self.told[p] = ",".join(map(str, ids))
        return found

    def forget(self) -> None:
        """Gives the kept ids' memory back; workers outlive their tasks."""
        self.known, self.told = {}, {}

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32)

    def ids_text(self, pieces: list[str]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.told.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return self.ids(self.pieces([text])[0]).tolist()

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids and the characters (start, end) that each covers; the parts of a character that is
        split over several ids all have that character's offsets."""
        found = self.whole.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of ids: their tokens' characters, each turned back into the byte that it stands for."""
        text = "".join(map(self.token.__getitem__, ids)).encode("utf-16-le")
        return self.back[np.frombuffer(text, np.uint16)].tobytes()

    def offsets(self, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the ids of a chunk's texts (``data`` and ``bounds`` of their UTF-8): the characters ``start`` to ``end`` of its
        text that each covers, in full or in part, and whether it holds only a part of one."""
        to = np.cumsum(self.size[ids])
        at = to - self.size[ids]
        first = np.append((data & 0xC0) != 0x80, True)
        character = np.cumsum(first) - 1
        base = character[bounds[:-1]][np.searchsorted(bounds, at, "right") - 1] if len(ids) else np.zeros(0, np.int64)
        return character[at] - base, character[np.maximum(to - 1, 0)] + 1 - base, ~(first[at] & first[to])

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Parts of one character that several ids hold come together again, as bytes
        are joined first; a character that the ids hold only in part becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text of ``docs (doc_id, text)``; ``with_offsets`` adds ``starts`` and
    ``ends``, the characters that each id covers (ids that share a character all have it). Null and empty
    texts have no ids. Strings of special tokens are ordinary text. ``path`` is a file that every
    executor has. Other columns are ignored; repeated rows, and rows without an id, give a row each; an empty table
    gives an empty result."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in _text.chunks(batches):
            ids = [c.ids(p) for p in c.pieces([t or "" for t in batch.column("text").to_pylist()])]
            every, count = np.concatenate(ids), np.array([len(x) for x in ids])
            columns = [batch.column("doc_id"), _text.lists(every, count, pa.int32())]
            if with_offsets:
                columns += [_text.lists(x.astype(np.int32), count, pa.int32()) for x in c.offsets(every, *_text.utf8(batch.column("text")))[:2]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"] + ["starts", "ends"] * with_offsets)
        c.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, data binary)``: adds the bytes that the ids stand for, through the reversed byte table, so that parts
    of a character in several ids come together; null and empty ids have none. Other columns are ignored, repeated
    rows give a row each, an empty table an empty result; ids that the file lacks are an error."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [c.decode_bytes(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(of, f"doc_id {kind}, ids array<int>, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, n_split, ids_sha256, decoded_sha256)``: encodes and decodes every text in one pass
    and returns digests of the ids (decimal, joined by commas) and of the decoded bytes; ``n_split`` counts the ids
    that hold a part of a character only; ``with_ids`` adds ``ids array<int>``. Null and empty texts have no ids and the
    digests of nothing. Other columns are ignored; repeated rows, and rows without an id, give a row each; an empty
    table gives an empty result."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in _text.chunks(batches):
            pieces = c.pieces([t or "" for t in batch.column("text").to_pylist()])
            every = [c.ids(p) for p in pieces]
            count = np.array([len(x) for x in every])
            split = np.concatenate([[0], np.cumsum(c.offsets(np.concatenate(every), *_text.utf8(batch.column("text")))[2])])
            to = np.cumsum(count)
            columns = [
                batch.column("doc_id"),
                pa.array(count, pa.int64()),
                pa.array(split[to] - split[to - count], pa.int64()),
                pa.array([hashlib.sha256(c.ids_text(p).encode()).hexdigest() for p in pieces], pa.string()),
                pa.array([hashlib.sha256(c.decode_bytes(x.tolist())).hexdigest() for x in every], pa.string()),
            ]
            if with_ids:
                columns.append(_text.lists(np.concatenate(every), count, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_split", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        c.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n_tokens long, n_split long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
