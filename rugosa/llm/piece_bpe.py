"""SentencePiece BPE encoding and decoding.

Merge-type vocabularies are encoded with a score-ordered agenda: all adjacent
symbol pairs that form a piece wait in a heap ordered by (score, position);
the best pair is merged, its two new neighbours enter the agenda, and stale
entries are skipped when they surface. No piece of such a vocabulary holds
white space after another character, so a merge never crosses the start of a
white-space run; texts are cut there, and each distinct segment of a worker is
run through the agenda once. Every segment that a worker meets for the first
time in a batch is also encoded by the sentencepiece library, and a difference
fails the job (``check="texts"`` compares every whole text instead).

Defined results: a null or empty text has no ids and decodes to the empty
string; texts of any length, ties (equal scores: the leftmost pair), repeated
rows and extra columns are handled row by row; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rugosa.llm.common import HEAD, Remembered, arrow_rows, id_text, joined_values, learn_in_parts, worker_object

SPACE = "▁"
#: Bytes of segments and their ids that a worker remembers, at most.
CACHE_BYTES = 96 << 20
#: Segments of up to this many characters keep their agenda in a list, not in a heap.
SHORT = 48
_NEVER = float("inf")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA_FULL = "doc_id long, ids array<int>, decoded string"


def _fields(data: bytes):
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceBpe:
    """The vocabulary of one model file, with agenda encoding and table decoding."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in message if k == 2)))
        normal = dict(_fields(next(v for k, v in message if k == 3)))
        # model type 2 is BPE; field 1 names the normaliser; 3 adds a leading
        # space, 4 drops repeated spaces
        if trainer.get(3) != 2 or normal.get(1, b"") != b"identity" or normal.get(3, 1) != 1 or normal.get(4, 1) != 0:
            raise ValueError("only BPE models with the identity normaliser and a leading space are handled")
        self.ids: dict[str, int] = {}
        self.order: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.table: list[bytes] = []
        self.is_byte: list[bool] = []
        self.unk = 0
        for n, piece in enumerate(dict(_fields(v)) for k, v in message if k == 1):
            text = piece[1].decode()
            kind = piece.get(3, 1)
            self.is_byte.append(kind == 6)
            if kind == 6:
                self.byte_ids[int(text[1:-1], 16)] = n
                self.table.append(bytes([int(text[1:-1], 16)]))
            elif kind in (2, 3):  # unknown, control
                self.unk = n if kind == 2 else self.unk
                self.table.append(trainer.get(44, b" \xe2\x81\x87 ") if kind == 2 else b"")
            elif kind == 1:
                self.ids[text] = n
                self.order[text] = -struct.unpack("<f", piece[2])[0]
                self.table.append(text.replace(SPACE, " ").encode())
            else:
                raise ValueError("unused and user-defined pieces are not handled")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds white space after another character")
        #: whether no merge joins a letter to a punctuation mark behind it
        self.in_parts = not any(HEAD.search(p) for p in self.ids)

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by the agenda of adjacent pairs."""
        if len(text) <= SHORT:
            return self._merge_short(text)
        symbols: list[str | None] = list(text)
        n = len(symbols)
        order = self.order
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in order:
                agenda.append((order[pair], i, i + 1, pair))
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or len(left) + len(right) != len(pair) or after[i] != j:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in order:
                    heapq.heappush(agenda, (order[new], i, k, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in order:
                    heapq.heappush(agenda, (order[new], h, i, new))
        return [s for s in symbols if s is not None]

    def _merge_short(self, text: str) -> list[str]:
        """The same agenda as a list with the order of each adjacent pair, searched for
        its least entry (the leftmost of equal ones)."""
        symbols = list(text)
        order = self.order.get
        agenda = [order(text[i : i + 2], _NEVER) for i in range(len(symbols) - 1)]
        while agenda and (best := min(agenda)) != _NEVER:
            i = agenda.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(pair + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + pair, _NEVER)
        return symbols

    def segment_ids(self, key: str) -> list[int]:
        """Ids of a space followed by ``key``."""
        return self.piece_ids(self.merge(SPACE + key.replace(" ", SPACE)))

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out = list(map(self.ids.get, pieces))
        if None not in out:
            return out
        out = []
        for piece in pieces:
            if (n := self.ids.get(piece)) is not None:
                out.append(n)
            else:  # an unknown character falls back to its bytes
                out += [self.byte_ids[b] for b in piece.encode()]
        return out

    def decode(self, ids) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and not self.is_byte[ids[0]] else text


_RUNS = re.compile(" +[^ ]*")


def segments(text: str) -> list[str]:
    """The text cut before every run of spaces, each segment without its first
    space (the one that the model adds stands before the first)."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [s[1:] for s in _RUNS.findall(" " + text)]
    return text.split(" ")


def cut_texts(texts: list[str]) -> pa.ListArray:
    """The segments of each text; Arrow cuts all texts at once when each single space cuts."""
    texts = [t.replace(SPACE, " ") for t in texts]
    if all(t and t[0] != " " and "  " not in t for t in texts):
        return pc.split_pattern(pa.array(texts, pa.string()), " ")
    return pa.array([segments(t) for t in texts], pa.list_(pa.string()))


class Encoder:
    """Encodes texts with a bounded memory of segments, checked by the library."""

    def __init__(self, model_file: str, check: str = "segments"):
        import sentencepiece

        self.model = PieceBpe(model_file)
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.check = check
        self.known = Remembered(CACHE_BYTES)
        self.decimal = [str(i) for i in range(self.library.get_piece_size())]

    def learn(self, fresh: list[str]) -> list[bytes]:
        """Run new segments through the agenda."""
        model = self.model
        one = lambda keys: [array("i", model.segment_ids(k)).tobytes() for k in keys]
        rest = lambda keys: [array("i", model.piece_ids(model.merge(k.replace(" ", SPACE)))).tobytes() for k in keys]
        found = learn_in_parts(fresh, self.known, one, rest) if model.in_parts else one(fresh)
        if self.check == "segments":
            # the library adds no leading space to an empty text
            full = [(s, i) for s, i in zip(fresh, found, strict=True) if s]
            for (s, i), other in zip(full, self.library.encode([s for s, _ in full], num_threads=1), strict=True):
                if i != array("i", other).tobytes():
                    raise AssertionError(f"segment {s[:200]!r}: {array('i', i)[:50].tolist()}, the library gives {other[:50]}")
        return found

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of each text."""
        out = []
        every, bounds = joined_values(cut_texts(texts), self.known, self.learn, "<i4")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids = array("i")
            ids.frombytes(every[a:b].tobytes())
            out.append(ids)
        if self.check == "texts":
            for text, ids, other in zip(texts, out, self.library.encode(texts, num_threads=1), strict=True):
                if ids.tolist() != other:
                    raise AssertionError(f"text {text[:200]!r} differs from the library")
        return out


def worker_encoder(model_file: str, check: str) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    return worker_object((Encoder, model_file, check), lambda: Encoder(model_file, check))


def encode_documents(docs: DataFrame, model_file: str, check: str = "segments") -> DataFrame:
    """doc_id, ids and decoded text of every document."""

    def make():
        encoder = worker_encoder(model_file, check)

        def rows(part):
            texts = [t or "" for _, t in part]
            return [
                (d, ids.tolist(), encoder.model.decode(ids) if ids else "")
                for (d, _), ids in zip(part, encoder.encode(texts), strict=True)
            ]

        return rows

    return arrow_rows(id_text(docs), SCHEMA_FULL, ["doc_id", "ids", "decoded"], make, keeps=True)


def digest_documents(docs: DataFrame, model_file: str, check: str = "segments", ids: bool = False) -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the decoded text (and the
    ids themselves) of every document."""
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if ids else 4]

    def make():
        encoder = worker_encoder(model_file, check)
        decimal = encoder.decimal.__getitem__

        def rows(part):
            out = []
            for (d, _), own in zip(part, encoder.encode([t or "" for _, t in part]), strict=True):
                decoded = encoder.model.decode(own) if own else ""
                row = (
                    d,
                    len(own),
                    hashlib.sha256(",".join(map(decimal, own)).encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )
                out.append((*row, np.frombuffer(own, dtype=np.int32)) if ids else row)
            return out

        return rows

    return arrow_rows(id_text(docs), SCHEMA + ", ids array<int>" * ids, columns, make, keeps=True)
