"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Only documents longer than a sequence are cut: full pieces after a first one that holds the rest.
Full pieces fill a sequence alone. How the rest is packed depends on nothing but how many pieces there
are of each length, at most ``capacity`` numbers, so the plan is made on the driver from that histogram:

* dominance reduction takes the longest piece and looks for a set with it that provably dominates every
  other set it could be in (alone if nothing fits; with a partner that fills the sequence; with the
  longest partner if two never fit; with the longest partner, or that and a third, if no other choice of
  two can use the space better). Such sets are fixed for as many pieces at once as the counts allow,
  and the instance shrinks;
* what no set dominates is packed best-fit decreasing, whole runs of one length at a time.

A plan is a list of slots (length, first rank, how many, first sequence, offset). Pieces are ranked
within their length in ``SALTS`` independent groups whose sizes add up to offsets, so no length is ever
ranked in one task, and each piece finds its slot by binary search in the broadcast plan, whose size the
capacity bounds.

Edge cases: a null or empty text is the end mark alone; repeated rows and null ids are packed like any
other row; an empty table gives an empty table; very long texts are cut into pieces, and texts with very long
runs of blanks or letters are encoded by the library that has no limit for them; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopyspark.llm.bpe import byte_letters
from canopyspark.llm.common import bounded, cut

SALTS = 128
#: The byte-level pre-tokenisation of the vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of one piece that the faster library is given at most: its pattern engine keeps a stack for white space,
#: and its merging of one piece takes time with the square of the length.
LONGEST = 4096
#: What may hold a longer piece: a run of white space, of letters, of numbers or of other characters.
KINDS = (r"\s", r"[^\W\d_]", r"\d", r"[^\s\w]", r"(?:[^\s\w]|_)", r"\w")
LONG_RUN = re.compile("|".join(f"{k}{{{LONGEST},}}" for k in KINDS))
#: Such a run covers one of the text's blocks of half its length; a block in plain text is left at its first blank.
HALF = LONGEST // 2
BLOCK_RUN = re.compile("|".join(f"{k}{{{HALF}}}" for k in KINDS))


def long_run(text: str) -> bool:
    """Whether LONG_RUN is found; only texts with a block of one kind are searched whole."""
    return any(BLOCK_RUN.match(text, at) for at in range(0, len(text) - HALF + 1, HALF)) and LONG_RUN.search(text) is not None


@lru_cache(2)
def exact(path: str) -> Tokenizer:
    """The vocabulary in the tokenizers library itself, for texts with very long pieces."""
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def encoded(path: str, text: str) -> list[int]:
    """The ids of a text: by the faster library, or by the tokenizers library where a run of one kind of character is very long."""
    if long_run(text):
        return exact(path).encode(text, add_special_tokens=False).ids
    return tokenizer(path).encode(text, allowed_special="all")


@lru_cache(2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """A byte-level vocabulary of the tokenizers library in the library that is faster at whole texts.

    Merge lists of byte-level vocabularies are in the order of their ids, so ranks by id merge alike.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@dataclass(frozen=True)
class Slot:
    """``count`` pieces of one length from rank ``first`` on: ``per`` in each sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    count: int
    per: int
    sequence: int
    offset: int


class Instance:
    """Counts of pieces by length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.used: dict[int, int] = defaultdict(int)
        self.sizes = sorted(self.left)

    def take(self, w: int, n: int) -> int:
        """Take n pieces of length w; the rank of the first."""
        first = self.used[w]
        self.used[w] += n
        self.left[w] -= n
        if not self.left[w]:
            del self.left[w]
            self.sizes.remove(w)
        return first

    def smallest(self, k: int, than: int = 0, without: int = 0) -> list[int]:
        """The k shortest pieces longer than ``than``, one of length ``without`` left out."""
        found: list[int] = []
        for w in self.sizes[bisect_right(self.sizes, than) :]:
            found += [w] * min(k - len(found), self.left[w] - (w == without))
            if len(found) == k:
                break
        return found

    def longest(self, room: int, *without: int) -> int:
        """The longest piece that fits, besides those named; 0 if none does."""
        for w in reversed(self.sizes[: bisect_right(self.sizes, room)]):
            if self.left[w] > without.count(w):
                return w
        return 0


def dominant(x: Instance, w: int, room: int) -> list[int] | None:
    """The partners of a piece of length w in a set that dominates every set with it, or None if none is proved.

    One set dominates another if the other's members can be dealt among its own without any being larger in sum.
    """
    first = x.longest(room, w)
    if not first:
        return []
    if first == room:
        return [first]
    small = x.smallest(3, without=w)
    if len(small) < 2 or small[0] + small[1] > room:
        return [first]
    if len(small) == 3 and sum(small) <= room:
        return None  # four pieces fit together: not decided by small sets
    second = x.longest(room - first, w, first)
    best_pair = max((a + b for a in x.sizes if a <= room - small[0] and (b := x.longest(room - a, w, a)) and b <= a), default=0)
    if best_pair <= first:
        return [first]
    if second:
        wider = x.smallest(2, than=second, without=w)
        if first + second == room or len(wider) < 2 or sum(wider) > room:
            return [first, second]
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int, dict[str, int]]:
    """Slots for all pieces, the number of sequences, and how many sequences each part of the method made."""
    x = Instance(counts)
    slots: list[Slot] = []
    sequences = 0
    made = {"dominance": 0, "best_fit": 0}

    def fix(lengths: list[int], n: int) -> None:
        nonlocal sequences
        offset = 0
        for w in dict.fromkeys(lengths):
            per = lengths.count(w)
            slots.append(Slot(w, x.take(w, n * per), n * per, per, sequences, offset))
            offset += per * w
        sequences += n
        made["dominance"] += n

    for w in reversed(list(x.sizes)):
        while x.left.get(w):
            found = dominant(x, w, capacity - w)
            if found is None:
                break
            lengths = [w, *found]
            fix(lengths, min(x.left[v] // lengths.count(v) for v in set(lengths)))

    # best-fit decreasing; open sequences by the room that is left: (first sequence, how many)
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    while x.sizes:
        w = x.sizes[-1]
        n = x.left[w]
        at = bisect_right(rooms, w - 1)
        if at < len(rooms):
            room = rooms[at]
            first, many = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
        else:
            room, first, many = capacity, sequences, n
        per = room // w
        full, rest = divmod(n, per)
        full = min(full, many)
        if full:
            slots.append(Slot(w, x.take(w, full * per), full * per, per, first, capacity - room))
            put(room - per * w, first, full)
            if room == capacity:
                sequences, made["best_fit"] = sequences + full, made["best_fit"] + full
            else:
                put(room, first + full, many - full)
        else:
            slots.append(Slot(w, x.take(w, rest), rest, rest, first, capacity - room))
            put(room - rest * w, first, 1)
            if room == capacity:
                sequences, made["best_fit"] = sequences + 1, made["best_fit"] + 1
            else:
                put(room, first + 1, many - 1)
    return slots, sequences, made


def pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end mark, cut where they exceed ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encoded(path, text.as_py() or ""), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                for p, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if p == 0 else stop - capacity
                    rows.append((k, p, start, stop - start, zlib.crc32(ids[start:stop])))
            k, p, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(p.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``."""
    # cut once: a second tokenisation would cost as much again, and row numbers must not change
    rows = cut(pieces(docs, path, capacity, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    part = rows.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    sizes = part.groupBy("length", "salt").agg(F.count("*").alias("n")).toArrow()  # capacity x SALTS rows at most
    length, salt, n = (sizes.column(c).to_numpy() for c in ("length", "salt", "n"))
    table = np.zeros((capacity, SALTS), dtype=np.int64)
    table[length, salt] = n
    before = np.cumsum(table, axis=1) - table
    slots, sequences, _ = plan({int(w): int(table[w].sum()) for w in np.unique(length)}, capacity)
    by_length = defaultdict(list)
    for s in slots:
        by_length[s.length].append((s.first, s.per, s.sequence, s.offset))
    found = {w: np.array(sorted(v), dtype=np.int64) for w, v in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast((before, found))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            rank = rank + before[length, salt]
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for w in np.unique(length):
                at = np.flatnonzero(length == w)
                own = found[int(w)]
                slot = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
                sequence[at] = slot[:, 2] + (rank[at] - slot[:, 0]) // slot[:, 1]
                offset[at] = slot[:, 3] + (rank[at] - slot[:, 0]) % slot[:, 1] * w
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = part.selectExpr(*columns, "salt", "row_number() over (partition by length, salt order by row) - 1 as rank").withColumn("rank", F.col("rank").cast("long"))
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    whole = rows.where(F.col("length") == capacity).select(*columns, (F.lit(sequences) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
