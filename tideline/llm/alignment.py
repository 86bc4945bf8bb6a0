"""Where the tokens of two tokenizers meet: groups between common byte offsets, and links between overlapping tokens.

A text is cut into units at places that no token of either tokenizer crosses (before a space behind other text, and
between a letter and a punctuation mark behind it), so a unit is encoded alike wherever it stands and every end of a unit is a
common offset. Each distinct unit of the corpus is encoded and aligned once, by explode, windows and grouping alone; how often
id pairs are linked follows from how often units come. Documents are lists of numbers of units of their chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm._store import discard, written
from tideline.llm._text import chunks, lists

#: Bytes of text whose documents share one numbering of units.
CHUNK = 24_000_000
#: Units encoded at once.
AT_ONCE = 20_000
#: Rows of units that are packed at once.
PACKED = 200_000
#: Id pairs that may be broadcast, three numbers each; more go through a shuffle join, to the same result.
PAIRS = 1_000_000

_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_SPACE = re.compile(r" (?<=\S )")
_MARKS = re.compile(rf"(?<=[{_LETTER}])(?=[{_MARK}])")
#: Stands before a unit so that no space is added to it; no piece goes on behind it.
_EDGE = "\n"


class Pair:
    """The byte-level tokenizer (A) and the piece tokenizer (B), with the bytes of all their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        back = _bytes_of_characters()
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        plain = [i for i in range(len(self.b)) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        names = {i: self.b.id_to_piece(i) for i in plain}
        self.b_bytes = {i: bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in names.items()}
        with open(byte_level, encoding="utf-8") as f:
            told = json.load(f)
        model = proto.ModelProto()
        with open(pieces, "rb") as f:
            model.ParseFromString(f.read())
        spec, split = model.normalizer_spec, told["pre_tokenizer"] or {}
        #: Whether all texts but those with U+2581 come back whole from either.
        self.whole = told["normalizer"] is None and {bytes([x]) for x in range(256)} <= set(self.a_bytes.values()) and spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and model.trainer_spec.byte_fallback
        crossing = re.compile(rf"[^▁]▁|[{_LETTER}][{_MARK}]|{_EDGE}.|.{_EDGE}", re.S)
        #: Whether no token crosses the end of a unit.
        self.cut = self.whole and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space") and spec.add_dummy_prefix and not any(crossing.search(names[i]) for i in plain if not self.b.is_byte(i))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with the space that goes before a text, or of units."""
        a = [x.ids for x in self.a.encode_batch(units, add_special_tokens=False)]
        if self.cut:
            return a, [x[2:] for x in self.b.encode([_EDGE + u for u in units], num_threads=1)]
        return a, self.b.encode([u[1:] for u in units], num_threads=1)

    def same(self, unit: str) -> bool:
        """Whether the tokens of either join to the unit."""
        a, b = self.encode([unit])
        want = unit.encode()
        return b"".join(self.a_bytes.get(i, b"") for i in a[0]) == want == b"".join(self.b_bytes.get(i, b"") for i in b[0])


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    others for characters from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Units(dict):
    """Words between spaces to the numbers of their units."""

    def __init__(self, pair: Pair):
        self.pair, self.number, self.lost = pair, {}, set()

    def __missing__(self, word: str) -> list[int]:
        units = _MARKS.split(" " + word) if self.pair.cut else [" " + word]
        found = [self.number.setdefault(u, len(self.number)) for u in units]
        if not self.pair.whole:
            self.lost.update(i for u, i in zip(units, found, strict=True) if not self.pair.same(u))
        self[word] = found
        return found

    def of(self, text: str | None) -> list[int] | None:
        """None if the text has no tokens."""
        if not text or "▁" in text:
            return None
        found = list(chain.from_iterable(map(self.__getitem__, _SPACE.split(text) if self.pair.cut else [text])))
        return None if self.lost and not self.lost.isdisjoint(found) else found


def _coded(byte_level: str, pieces: str, kind: pa.DataType):
    """Texts to rows (chunk, doc_id, units) and, for each chunk, one (chunk, words, counts) of its units in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, chunk = Pair(byte_level, pieces), TaskContext.get().partitionId() << 32, 0
        units, counts, size = _Units(pair), np.zeros(0, np.int64), 0
        int_list, names = pa.list_(pa.int32()), ["chunk", "doc_id", "units", "words", "counts"]

        def ended() -> pa.RecordBatch:
            words = pa.array([list(units.number)], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([part + chunk]), pa.nulls(1, kind), pa.nulls(1, int_list), words, lists(np.pad(counts, (0, len(units.number) - len(counts))), np.array([len(units.number)]))], names)

        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            found = [units.of(t) for t in texts]
            every = np.fromiter(chain.from_iterable(x for x in found if x), np.int64)
            if len(every):
                seen = np.bincount(every, minlength=len(units.number))
                seen[: len(counts)] += counts
                counts = seen
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part + chunk)), batch.column("doc_id").cast(kind), pa.array(found, int_list), pa.nulls(len(found), pa.list_(pa.string())), pa.nulls(len(found), pa.list_(pa.int64()))], names)
            size += sum(len(t) for t in texts if t)
            if size > CHUNK:
                yield ended()
                chunk += 1
                units, counts, size = _Units(pair), np.zeros(0, np.int64), 0
        if units.number:
            yield ended()

    return run


def _encoded(byte_level: str, pieces: str):
    """Rows (word, chunk, idx, n) in order of words to a row (w, n, a, al, b, bl) for each word, with ids and byte lengths of its
    tokens, and a row (w, chunk, idx) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, w = Pair(byte_level, pieces), (TaskContext.get().partitionId() << 40) - 1
        length = [np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int32) for of in (pair.a_bytes, pair.b_bytes)]
        names, int_list = ["w", "n", "a", "al", "b", "bl", "chunk", "idx"], pa.list_(pa.int32())
        last, total, waiting = None, 0, []

        def encoded() -> pa.RecordBatch:
            out = []
            for ids, of in zip(pair.encode([x[0] for x in waiting]), length, strict=True):
                flat, count = np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids])
                out += [lists(flat.astype(np.int32), count, pa.int32()), lists(of[flat], count, pa.int32())]
            n = len(waiting)
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in waiting], pa.int64()), pa.array([x[2] for x in waiting], pa.int64()), *out, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)

        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            for k, (word, n) in enumerate(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                if word != last:
                    if last is not None:
                        waiting.append((last, w, total))
                    last, total, w = word, 0, w + 1
                total += n
                at[k] = w
            none = pa.nulls(len(at), int_list)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.int64()), none, none, none, none, batch.column("chunk"), batch.column("idx")], names)
            if len(waiting) >= AT_ONCE:
                yield encoded()
                waiting = []
        if last is not None:
            waiting.append((last, w, total))
            yield encoded()

    return run


def aligned(tokens: DataFrame) -> DataFrame:
    """``(w, n, n_a, n_b, n_groups, groups, links)`` of rows ``(w, n, a, al, b, bl)``: ids of two tokenizers with their lengths in bytes;
    the groups as text and the linked id pairs, each a number ``a * 2^32 + b``. ``w`` is distinct. Any number of tokens is cut in
    linear time: one shuffle of the lists, and all windows and groups stay where that put them."""
    side = lambda ids, lens, s: F.transform(F.arrays_zip(ids, lens), lambda x, i: F.struct(F.lit(s).alias("side"), i.alias("pos"), x[ids].alias("id"), x[lens].alias("len")))
    each = tokens.repartition("w").select("w", "n", F.explode(F.concat(side("a", "al", "a"), side("b", "bl", "b"))).alias("t")).select("w", "n", "t.*")
    run = Window.partitionBy("w", "side").orderBy("pos")
    ends = each.withColumn("start", F.sum("len").over(run) - F.col("len"))  # the end of the token before
    # offsets are distinct on each side, so that grouping by them is the full outer equi-join of both sides, without a shuffle of its own
    met = ends.groupBy("w", "start").agg(F.first("n").alias("n"), F.max(F.when(F.col("side") == "a", F.col("id"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("id"))).alias("b"))
    so_far = Window.partitionBy("w").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    linked = met.select(
        "w", "n", "start", "a", "b",
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).over(so_far).alias("g"),
        F.last("a", ignorenulls=True).over(so_far).alias("at_a"),
        F.last("b", ignorenulls=True).over(so_far).alias("at_b"),
    )
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("start", c)))), lambda x: x[c]), ",")
    groups = linked.groupBy("w", "g").agg(
        F.first("n").alias("n"),
        F.count("a").alias("n_a"),
        F.count("b").alias("n_b"),
        F.concat(in_order("a"), F.lit("|"), in_order("b")).alias("text"),
        F.collect_list(F.shiftleft(F.col("at_a").cast("long"), 32) + F.col("at_b")).alias("links"),
    )
    return groups.groupBy("w").agg(
        F.first("n").alias("n"),
        F.sum("n_a").alias("n_a"),
        F.sum("n_b").alias("n_b"),
        F.count("*").alias("n_groups"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "text"))), lambda x: x["text"]), ";").alias("groups"),
        F.flatten(F.collect_list("links")).alias("links"),
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """``(link, count, best)`` of rows ``(link, n)``: how many links hold each id pair, and whether no pair of the same B id has more."""
    counts = links.groupBy("link").agg(F.sum("n").alias("count"))
    b = F.col("link").bitwiseAND(0xFFFFFFFF)
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b)))


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _packed() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of figures of units to one row (chunk, idx, figures, groups) for many units of a chunk: numbers as bytes, texts as
    lines of one. What is dealt and sorted by chunk are these few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            of = rows.column("chunk").to_numpy()
            order = np.argsort(of, kind="stable")
            of = of[order]
            bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), [len(of)]])
            idx = rows.column("idx").to_numpy().astype(np.int32)[order]
            figures = np.stack([rows.column(c).to_numpy() for c in _FIGURES]).astype(np.int64)[:, order]
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            texts = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows.column("groups").take(pa.array(order)).combine_chunks())
            told = [pa.array(of[bounds[:-1]]), pa.array([idx[x:y].tobytes() for x, y in spans]), pa.array([figures[:, x:y].tobytes() for x, y in spans]), pc.binary_join(texts, "\n")]
            return pa.RecordBatch.from_arrays(told, ["chunk", "idx", "figures", "groups"])

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= PACKED:
                yield packed()
                waiting, size = [], 0
        if size:
            yield packed()

    return run


def _summed(kind: pa.DataType):
    """Packed rows of a chunk's units, then its documents, to the figures of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, figures, told, parts = None, np.zeros((len(_FIGURES), 0), np.int64), [], []

        def ready() -> None:
            nonlocal figures, told, parts
            if parts:
                at = np.concatenate([p[0] for p in parts])
                order = np.argsort(at)
                figures = np.concatenate([p[1] for p in parts], axis=1)[:, order]
                every = list(chain.from_iterable(p[2].split("\n") for p in parts))
                told, parts = [every[i] for i in order.tolist()], []

        for whole in batches:
            of = whole.column("chunk").to_numpy()
            doc = whole.column("groups").is_null().to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])])) if len(of) else []
            for start, end in zip(bounds, [*bounds[1:], len(of)], strict=True):
                batch = whole.slice(start, end - start)
                if of[start] != chunk:
                    chunk, figures, told, parts = of[start], np.zeros((len(_FIGURES), 0), np.int64), [], []
                if not doc[start]:
                    for idx, numbers, groups in zip(*(batch.column(c).to_pylist() for c in ("idx", "figures", "groups")), strict=True):
                        parts.append((np.frombuffer(idx, np.int32), np.frombuffer(numbers, np.int64).reshape(len(_FIGURES), -1), groups))
                    continue
                ready()
                lists_ = batch.column("units")
                count = np.diff(lists_.offsets.to_numpy()) if not lists_.null_count else lists_.value_lengths().fill_null(0).to_numpy()
                flat = lists_.flatten().to_numpy()
                first = np.concatenate([[0], np.cumsum(count)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(f[flat])])[first]) for f in figures]
                ids = flat.tolist()
                digests = [hashlib.sha256(";".join([told[i] for i in ids[x:y]]).encode()).hexdigest() if y > x else "" for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kind), *[pa.array(s, pa.int64()) for s in sums], pa.array(digests, pa.string())], ["doc_id", *_FIGURES, "groups_sha256"])

    return run


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for each row of ``docs`` (``doc_id``, ``text`` and any
    other columns).

    A is the byte-level tokenizer in the file ``byte_level`` on a space and the text, B the piece tokenizer in ``pieces`` on the text,
    to which it adds the space. Texts that are null, empty or not the same again from their tokens have zeros and an empty
    digest, and count nowhere. Repeated rows count again; ids may be null. An empty table gives no rows. Texts of any length
    are aligned whole; where a tokenizer's tokens could cross units, a text is one unit.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    coded = written(docs.select("doc_id", "text").mapInArrow(_coded(byte_level, pieces, kind), f"chunk long, doc_id {id_type}, units array<int>, words array<string>, counts array<long>"), "coded")
    of_chunk = coded.where("words is not null").select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("idx", "x")).select("chunk", "idx", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    own = of_chunk.where("n > 0").repartition("word").sortWithinPartitions("word")
    units = written(own.mapInArrow(_encoded(byte_level, pieces), "w long, n long, a array<int>, al array<int>, b array<int>, bl array<int>, chunk long, idx int"), "units")
    met = written(aligned(units.where("a is not null").select("w", "n", "a", "al", "b", "bl")), "aligned")
    links = met.select("w", "n", F.explode("links").alias("link"))
    counts = written(pair_counts(links), "pairs")
    small = F.broadcast(counts) if counts.count() <= PAIRS else counts
    sums = links.join(small, "link").groupBy("w").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    figures = met.select("w", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups").join(sums, "w")
    told = written(units.where("chunk is not null").select("w", "chunk", "idx").join(figures, "w").select("chunk", "idx", "groups", *_FIGURES).mapInArrow(_packed(), "chunk long, idx binary, figures binary, groups string"), "told")
    discard(units, met, counts)
    rows = told.unionByName(coded.where("words is null").select("chunk", "doc_id", "units"), allowMissingColumns=True)
    ready = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("groups").isNull())
    return ready.mapInArrow(_summed(kind), f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
