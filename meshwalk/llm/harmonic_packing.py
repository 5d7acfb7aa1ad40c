"""Harmonic packing of token sequences (operator 8).

Lengths fall into reciprocal-capacity classes: a piece of length l with
capacity / (k + 1) < l <= capacity / k is of class k, and k of them fill a
sequence. Every class has one open sequence in a worker and closes it at exactly k
pieces, so workers pack independently, in one pass and without a shuffle, with
state bounded by the classes whatever the input.

Documents may be cut. Whole capacities come off first; a rest that would leave
more than ``slack`` tokens unused in its share of a sequence gives up a piece of
exactly capacity / k, where nothing is lost, and goes on with what remains, at
most ``cuts`` times. What is open at a task's end is laid end to end and cut at
the capacity, so a task leaves one padded sequence at most.

Ids come from the tokenizer file given. A byte-level BPE file whose merges are in
the order of their ids, without flags on its added tokens, is run by a faster engine
on the same vocabulary, which gives the same ids; any other file by the tokenizers library.

Defined results: null or empty text is the end id alone; a text of any length is
packed as a whole; repeated rows are packed each on its own; a null doc_id stays null;
other columns, whatever their names, aren't looked at; an empty table gives no
pieces. A task
that is run again makes the same sequences, whose ids carry the partition number.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

ship(__name__)

CAPACITY, END, SLACK, CUTS, FINE = 1024, 0, 16, 2, 64
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files, as their format defines it."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


def load_encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids gives."""
    spec = json.load(open(path, encoding="utf-8"))  # a file of the installed library, on every executor
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, special = model.get("vocab", {}), {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ids = [vocab.get(a + b) for a, b in merges] if model.get("type") == "BPE" else []
    flagged = any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    plain = not flagged and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if plain and ids and None not in ids and all(x < y for x, y in zip(ids, ids[1:], strict=False)):
        import tiktoken

        code = _byte_symbols()
        ranks = {bytes(code[c] for c in token): i for token, i in vocab.items() if token not in special}
        # The byte-level split of the file format, as that library writes it.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        marks = tuple(special)
        return lambda t: engine.encode(t, allowed_special="all") if any(m in t for m in marks) else engine.encode_ordinary(t)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def encoder(path: str) -> Callable[[str], list[int]]:
    """load_encoder once in a worker process."""
    held = sys.modules.setdefault("_meshwalk_held", types.ModuleType("_meshwalk_held")).__dict__
    if path not in held:
        held[path] = load_encoder(path)
    return held[path]


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """How many pieces of this length's class fill a sequence; powers of two beyond FINE."""
    k = capacity // length
    return k if k <= FINE else 1 << (k.bit_length() - 1)


def cut_lengths(total: int, capacity: int = CAPACITY, slack: int = SLACK, cuts: int = CUTS) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids, in order."""
    out, rest = [capacity] * (total // capacity), total % capacity
    for _ in range(cuts):
        if not rest or capacity / class_of(rest, capacity) - rest <= slack:
            break
        exact = capacity // -(-capacity // rest)
        if not 0 < exact < rest:
            break
        out.append(exact)
        rest -= exact
    return [*out, rest] if rest else out


class Packer:
    """Sequences of one worker. add() and close() return finished pieces: (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first: int, capacity: int = CAPACITY, slack: int = SLACK, cuts: int = CUTS):
        self.next, self.capacity, self.slack, self.cuts = first, capacity, slack, cuts
        self.open: dict[int, list[tuple]] = {}

    def _placed(self, pieces: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        for n in cut_lengths(len(ids), self.capacity, self.slack, self.cuts):
            k = class_of(n, self.capacity)
            self.open.setdefault(k, []).append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(self.open[k]) == k:
                out += self._placed(self.open.pop(k))
        return out

    def close(self) -> list[tuple]:
        out, row, room = [], [], self.capacity
        for doc, start, ids, total in (p for k in sorted(self.open) for p in self.open[k]):
            while len(ids):
                row.append((doc, start, ids[:room], total))
                start, room, ids = start + len(row[-1][2]), room - len(row[-1][2]), ids[room:]
                if not room:
                    out += self._placed(row)
                    row, room = [], self.capacity
        self.open = {}
        return out + (self._placed(row) if row else [])


def _pack(path: str, capacity: int, slack: int, cuts: int, with_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, kind = encoder(path), Packer(TaskContext.get().partitionId() << 33, capacity, slack, cuts), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([r[0] for r in rows], kind), *(pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].tobytes()) for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols, names = [*cols, pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            kind = b.column(0).type
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += packer.add(doc, np.array([*encode(text or ""), END], "<u4"))
            yield out(rows)
        if kind is not None:
            yield out(packer.close())

    return of


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: int = SLACK, cuts: int = CUTS, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds each piece's ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_pack(tokenizer_path, capacity, slack, cuts, with_ids), schema)
