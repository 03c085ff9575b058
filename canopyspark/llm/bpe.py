"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A text is read in blocks that end at white space, where no token, no special token and no canonical
composition can cross; where there is none, a block ends within a run of letters or signs, whose piece stays
open. Blocks are normalised and cut into pieces, and each piece runs through the transducer, which holds a
window of symbols; a cache of bounded size remembers what it gave for short pieces:

The merge list fixes how much lookahead suffices. Let two inputs agree on their first n symbols and
apply the merges in rank order to both. The agreed tokens shrink only when a merge takes the last of them
as its left part; the symbol that then starts the disputed region is that left part, so the next merge
which shrinks them has a right part whose derivation starts with it. The longest such chain of merges by
rising rank, weighted by the lengths of their left parts, bounds what can ever change. Tokens that end
that many symbols before the end of the known input are stable: they are emitted and forgotten. This
needs a list where no merge precedes the merges that make its parts, which is checked.

Decoding walks the ids with a state machine: byte-level vocabularies give bytes to an incremental UTF-8
decoder; a vocabulary without a decoder gives its pieces with a space between.

Edge cases: a null text is empty; an empty text has no tokens and decodes to an empty text; strings of
special tokens in a text become those tokens; a very long text without blanks is read in blocks all the same; repeated rows and null ids keep a row each; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from canopyspark.llm.common import bounded

#: Characters that are read at once, at least; a block ends at white space.
BLOCK = 1 << 16
#: Pieces that the cache of one process holds.
CACHE = 250_000
NO_RANK = 1 << 60


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def ranges(kept) -> str:
    """A regular expression's class body for the code points that ``kept`` accepts."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and kept(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def new_characters() -> tuple[set[str], set[str], dict[int, str]]:
    """Letters, numbers and lower cases that the tokenizers library knows and this Python's tables do not.

    Only character tables are read from the library, so that text of a newer Unicode version is cut alike.
    """
    unknown = [chr(c) for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]

    def of(kind: str) -> set[str]:
        return {c for piece, _ in Split(Regex(kind), "removed", invert=True).pre_tokenize_str("".join(unknown)) for c in piece}

    lower = zip(unknown, Lowercase().normalize_str(" ".join(unknown)).split(" "), strict=True)
    return of(r"\p{L}"), of(r"\p{N}"), {ord(c): x for c, x in lower if c != x}


SPACE = "".join(f"\\u{c:04x}" for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


@lru_cache(1)
def piece_patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+ for the standard library, which is the faster one.

    For lower-case ASCII, for the basic plane without newer characters, and for any text; then what
    finds a newer character in the basic plane. Classes lack \p{} there, so what they say otherwise
    of a code point, by an older table or by their definition, is listed by range.
    """
    parts = "'s|'t|'re|'ve|'m|'ll|'d"
    letters, numbers, _ = new_characters()

    def odd(last: int) -> str:  # in \w but not in \d, and not letters
        return ranges(lambda c: ord(c) <= last and unicodedata.category(c) in ("Nl", "No"))

    new, more = ranges(lambda c: c in letters), ranges(lambda c: c in numbers)
    basic, full = odd(0xFFFF), odd(sys.maxunicode) + more
    return (
        re.compile(rf"{parts}|[a-z]+|[0-9]|[!-/:-@\[-`{{-~\x00-\x08\x0e-\x1f\x7f]+"),
        re.compile(rf"{parts}|[^\W\d_{basic}]+|[\d{basic}]|(?:[^\w{SPACE}{basic}]|_)+"),
        re.compile(rf"{parts}|(?:[^\W\d_{full}]" + (f"|[{new}]" if new else "") + rf")+|[\d{full}]|(?:[^\w{SPACE}{full}{new}]|_)+"),
        re.compile("[" + (ranges(lambda c: c <= "\uffff" and (c in letters or c in numbers)) or "\ufdd0") + "]"),
    )


def pieces(text: str) -> list[str]:
    """The pieces of a block in normal form, lower case."""
    ascii_only, basic, full, newer = piece_patterns()
    if text.isascii():
        return ascii_only.findall(text.lower())
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    if max(text) <= "\uffff" and not newer.search(text):
        return basic.findall(text.lower())
    return full.findall(text.translate(new_characters()[2]).lower())


class Merges:
    """A merge list over token ids: rank and result of each pair, and its sufficient lookahead in symbols."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.suffix = suffix
        self.vocab = vocab
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int]] = {}
        length: dict[int, int] = {}
        made: dict[int, int] = {}
        self.proper = True
        rows = []
        for rank, merge in enumerate(merges):
            left, right = merge if not isinstance(merge, str) else merge.split(" ")
            a, b = vocab[left], vocab[right]
            t = vocab[left + right]
            self.pairs[a, b] = (rank, t)
            rows.append((a, b, t))
            for x in (a, b):
                self.proper &= x in made or len(x_text := self._plain(left if x == a else right)) == 1 or not x_text
                length.setdefault(x, 1)
            if t in parts:
                self.proper = False
            parts[t] = (a, b)
            made[t] = rank
            length[t] = length[a] + length[b]
        self.packed = {a << 20 | b: rank << 20 | t for (a, b), (rank, t) in self.pairs.items()}
        used = {}
        for rank, (a, b, _) in enumerate(rows):
            for x in (a, b):
                used.setdefault(x, rank)
        self.proper &= all(used.get(t, NO_RANK) > rank for t, rank in made.items())
        self.length = length
        self.lookahead = self._lookahead(rows, parts)
        self.window = max(256, 4 * self.lookahead)

    def _plain(self, token: str) -> str:
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def _lookahead(self, rows: list[tuple[int, int, int]], parts: dict[int, tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        most = 0
        for a, b, _ in reversed(rows):
            chain = self.length[a] + best.get(a, 0)
            most = max(most, chain)
            start = b
            while True:  # the tokens that start the right part's derivation, itself included
                best[start] = max(best.get(start, 0), chain)
                if start not in parts:
                    break
                start = parts[start][0]
        return most + 1  # the last symbol carries the mark of a word's end, so it is known one symbol late

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of a short piece: the lowest rank first, leftmost first."""
        get = self.packed.get
        ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_RANK:
            i = ranks.index(least)
            ids[i] = made = least & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << 20 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | made, NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """As merge(), with a heap, for windows."""
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x, y in zip(ids, alive, strict=True) if y]

    def running(self) -> Running:
        return Running(self)


class Running:
    """The transducer at work on one piece of any length: symbols in, tokens out once nothing can change them, in constant memory."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> list[int]:
        """The tokens that these symbols make stable."""
        m, held, out = self.merges, self.held, []
        symbols = iter(symbols)
        while True:
            held += islice(symbols, m.window - len(held))
            if len(held) < m.window or not m.proper:
                held += symbols  # none are left, or no token is ever known early
                return out
            limit, size, stable = len(held) - m.lookahead, 0, 0
            tokens = m.merge_long(list(held))
            for t in tokens:
                if size + m.length.get(t, 1) > limit:
                    break
                size += m.length.get(t, 1)
                stable += 1
            if not stable:
                held += islice(symbols, m.window)
                continue
            out += tokens[:stable]
            del held[:size]

    def finish(self, last: int) -> list[int]:
        """The tokens that are left when the piece ends with the symbol ``last``: nothing follows, so all are stable."""
        held = [*self.held, last]
        self.held = []
        return self.merges.merge(held) if len(held) <= 64 else self.merges.merge_long(held)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """One tokenizer file: normalised pieces with end-of-word marks in, ids out, and back."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if not self.suffix or model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary with end-of-word marks is needed")
        self.vocab = model["vocab"]
        self.merges = Merges(self.vocab, model["merges"], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.longest = max(map(len, self.special), default=0)
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        codec = self

        class Known(dict):
            """Piece -> its ids, packed."""

            def __missing__(self, piece: str) -> bytes:
                found = codec.piece(piece)
                if len(piece) <= 64:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = found
                return found

        self.known = Known()

    def piece(self, piece: str) -> bytes:
        """The ids of a whole piece: what the transducer emits for it. Pieces do not influence each other, so they may be remembered."""
        run, data = self.merges.running(), piece.encode("utf-8", "surrogatepass")
        ids = run.feed(map(self.inner.__getitem__, memoryview(data)[:-1]))
        return packed(ids + run.finish(self.final[data[-1]]))

    def soft(self, text: str, at: int, stop: int) -> int:
        """Where a block without white space may end: within a run of letters or of signs, with no special token, contraction or composition across. 0 if nowhere."""
        for p in range(stop, max(at + 4, stop - 256), -1):
            a, b = text[p - 1], text[p]
            alike = a.isalpha() and b.isalpha() or not (a.isalnum() or b.isalnum() or unicodedata.category(a)[0] in "NM" or unicodedata.category(b)[0] in "NM")
            if alike and unicodedata.category(b)[0] != "M" and not 0x1160 <= ord(b) <= 0x11FF and "'" not in text[p - 4 : p + 4] and "<" not in text[max(at, p - self.longest) : p + 1]:
                return p
        return 0

    def blocks(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether the last piece of each goes on in the next: only where there is no white space to end it at."""
        at = 0
        while at < len(text):
            size = BLOCK
            while True:
                stop, open_ = at + size, False
                if stop >= len(text):
                    stop = len(text)
                    break
                cut = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if cut >= at:
                    stop = cut + 1
                    break
                if found := self.soft(text, at, stop):
                    stop, open_ = found, True
                    break
                size *= 2
            yield text[at:stop], open_
            at = stop

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids, packed as little-endian unsigned 32-bit integers, a block at a time."""
        known = self.known.__getitem__
        run, last = None, 0  # a piece that is still open, and its last byte so far
        for block, open_ in self.blocks(text or ""):
            parts = self.at_special.split(block) if self.at_special and "<" in block else [block]
            for k, part in enumerate(parts):
                if k % 2:
                    yield packed([self.special[part]])
                    continue
                found = pieces(part) if part else []
                if run is not None and found:  # the first piece goes on with the open one
                    data = found.pop(0).encode("utf-8", "surrogatepass")
                    yield packed(run.feed(map(self.inner.__getitem__, bytes([last]) + data[:-1])))
                    last = data[-1]
                    if found or not open_ or k < len(parts) - 1:
                        yield packed(run.finish(self.final[last]))
                        run = None
                if open_ and k == len(parts) - 1 and found:
                    run, data = self.merges.running(), found.pop().encode("utf-8", "surrogatepass")
                    before, last = data[:-1], data[-1]
                    yield b"".join(map(known, found)) + packed(run.feed(map(self.inner.__getitem__, before)))
                elif found:
                    yield b"".join(map(known, found))

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids, a block at a time."""
        if self.byte_level:
            machine = codecs.getincrementaldecoder("utf-8")("replace")
            for block in blocks:
                yield machine.decode(b"".join(self.raw(i) for i in np.frombuffer(block, dtype="<u4").tolist()))
            yield machine.decode(b"", final=True)
            return
        name, begun = self.names.__getitem__, False
        for block in blocks:
            if block:
                yield (" " if begun else "") + " ".join(map(name, np.frombuffer(block, dtype="<u4").tolist()))
                begun = True

    def raw(self, i: int) -> bytes:
        return bytes(self.byte_of[c] for c in self.names[i]) if i not in self.special.values() else self.names[i].encode()

    def text(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Readable text of packed ids: bytes through an incremental UTF-8 decoder, a space after each word's end."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            out = []
            for i in np.frombuffer(block, dtype="<u4").tolist():
                token = self.names[i]
                if i < len(self.names) and token in self.special:
                    out.append(machine.decode(token.encode()))
                    continue
                ends = token.endswith(self.suffix)
                out.append(machine.decode(bytes(self.byte_of[c] for c in (token[: -len(self.suffix)] if ends else token)) + b" " * ends))
            yield "".join(out)
        yield machine.decode(b"", final=True)


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(b"".join(c.encode(batch.column(1)[k].as_py())), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays([0, len(ids)], pa.array(ids))], names=["doc_id", "ids"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of ``rows``; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = ["".join(c.decode([np.array(x.as_py() or [], dtype="<u4").tobytes()])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded in one pass, in constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1):
                size, ours, theirs = 0, hashlib.sha256(), hashlib.sha256()

                def told(blocks: Iterator[bytes], ours=ours) -> Iterator[bytes]:
                    nonlocal size
                    for block in blocks:
                        size += len(block) // 4
                        ours.update(block)
                        yield block

                for piece in c.decode(told(c.encode(text.as_py()))):
                    theirs.update(piece.encode())
                n.append(size)
                ids.append(ours.hexdigest())
                back.append(theirs.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
