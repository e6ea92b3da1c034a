"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass (operator 3).

The automaton's output links name, at each position, all pieces that end there, the longest first; each relaxes the best
score of its end. The segmentation is the one with the highest sum of piece scores. Pieces begin with their white space, so
a text falls apart exactly before each run of it, and a task encodes a repeated segment once.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED, CACHED_LENGTH, ROWS = 400_000, 64, 256  # segments that a task keeps, some 200 bytes each


class Vocabulary:
    """Pieces and scores of a model file, with its automaton. What the file says about merges is not used."""

    def __init__(self, model: bytes):
        file = SentencePieceProcessor(model_proto=model)
        probe = "ＡＢ ①  é\u0301 a b "
        if file.normalize(probe) != SPACE + probe.replace(" ", SPACE) or file.normalize("a") != f"{SPACE}a":
            raise ValueError("this file's texts are normalised or get no space in front; only files that keep texts as they are can be used")
        self.pieces = [file.id_to_piece(i) for i in range(file.get_piece_size())]
        self.unknown, self.automaton, letters, scores, own = file.unk_id(), ahocorasick.Automaton(), set(), [], []
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if file.is_byte(i)}
        for i, piece in enumerate(self.pieces):
            if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i)):
                self.automaton.add_word(piece, (len(piece), file.get_score(i), i))
                letters.update(piece)
                scores.append(file.get_score(i))
                own.append(piece)
        self.automaton.make_automaton()
        self.letters, self.unknown_score = letters, min(scores) - UNKNOWN_PENALTY
        self.single = {p for p in own if len(p) == 1}
        #: A boundary before white space splits no piece only if pieces have theirs in front; a letter of no piece always stands alone.
        apart = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in own)
        line = "" if "\n" in letters else "\n"
        self.segments = re.compile(f"[{line}]|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line and apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s:.+)").findall
        self.cache: dict[str, bytes] = {}

    def best(self, segment: str) -> list[int]:
        """Ids of the segment's best path. Ties: the longest last piece."""
        n = len(segment)
        score, back, at = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1), 0
        foreign = not self.single.issuperset(segment)  # else every letter is a piece, and no unknown one is needed
        for end, (length, gain, piece) in self.automaton.iter(segment):
            if foreign and end >= at:
                self._singles(segment, score, back, at, end)
                at = end + 1
            if (total := score[end + 1 - length] + gain) > score[end + 1]:
                score[end + 1], back[end + 1] = total, (length, piece)
        if foreign:
            self._singles(segment, score, back, at, n)
        path: list[tuple[int, int, int]] = []
        end = n
        while end:
            length, piece = back[end]
            path.append((end - length, end, piece))
            end -= length
        if not foreign:
            return [piece for *_, piece in reversed(path)]
        out: list[int] = []
        for start, end, piece in reversed(path):
            if piece != self.unknown:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in segment[start:end].encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _singles(self, segment: str, score: list[float], back: list[tuple[int, int]], start: int, end: int) -> None:
        """Each letter that is no piece itself also ends an unknown piece of one letter."""
        for i in range(max(0, start - 1), end):
            if segment[i] not in self.single and (total := score[i] + self.unknown_score) > score[i + 1]:
                score[i + 1], back[i + 1] = total, (1, self.unknown)

    def packed(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers, little end first."""
        if not text:
            return b""
        out: list[bytes] = []
        cache = self.cache
        for segment in self.segments(SPACE + text.replace(" ", SPACE)):
            ids = cache.get(segment)
            if ids is None:
                ids = np.array(self.best(segment), "<i4").tobytes()
                if len(segment) <= CACHED_LENGTH:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[segment] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD. Unknown ids without bytes give U+2047."""
        raw = self.__dict__.get("raw")
        if raw is None:
            of = {i: bytes([b]) for b, i in self.bytes.items()}
            raw = self.raw = [of.get(i, b"" if p in ("<s>", "</s>") else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
            raw[self.unknown] = " ⁇ ".encode()
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, Vocabulary] = {}


def vocabulary(sent) -> Vocabulary:
    """The vocabulary of a broadcast (digest, file), once for each file in each Python worker."""
    digest, file = sent.value
    if digest not in _loaded:
        _loaded[digest] = Vocabulary(file)
    return _loaded[digest]


def _sent(documents: DataFrame, model: str):
    """The model file, some MB at most, as a broadcast."""
    with open(model, "rb") as file:
        held = file.read()
    Vocabulary(held)  # an error for a file that can't be used comes here and not from a task
    return documents.sparkSession.sparkContext.broadcast((hashlib.sha256(held).hexdigest(), held))


def encoded(documents: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row; a null or empty text has no ids. model: path of a public model file on the driver."""
    name, kind = _sent(documents, model), dict(documents.dtypes)[key]

    def of(batches):
        words = vocabulary(name)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [np.frombuffer(words.packed(x.as_py()), "<i4") for x in batch.column(1)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids) if ids else np.array([], np.int32))], [key, "ids"])

    return documents.select(key, "text").mapInArrow(of, f"{key} {kind}, ids array<int>")


def decoded(ids: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of (key, ids); null ids give an empty text."""
    name, kind = _sent(ids, model), dict(ids.dtypes)[key]

    def of(batches):
        words = vocabulary(name)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], [key, "text"])

    return ids.select(key, "ids").mapInArrow(of, f"{key} {kind}, text string")


def round_trips(documents: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """key, ids array<int>, n_pieces, ids_sha256 (of the ids as 32-bit numbers, little end first), n_bytes (ids that are single bytes), n_unknown, decodes.

    One pass encodes each whole text, decodes the ids again and compares. decodes is false only where a text holds U+2581
    itself, which the format doesn't tell from a space. Null and empty texts have no pieces and decode. Every row gives
    a row; only key and text are read.
    """
    name, kind = _sent(documents, model), dict(documents.dtypes)[key]

    def of(batches):
        words = vocabulary(name)
        is_byte = np.zeros(len(words.pieces), bool)
        is_byte[list(words.bytes.values())] = True
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            columns: list[list] = [[], [], [], [], [], []]
            for x in batch.column(1):
                text = x.as_py() or ""
                packed = words.packed(text)
                ids = np.frombuffer(packed, "<i4")
                row = (ids, len(ids), hashlib.sha256(packed).hexdigest(), int(is_byte[ids].sum()), int((ids == words.unknown).sum()), words.decode(ids.tolist()) == text)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.list_(pa.int32()), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "ids", "n_pieces", "ids_sha256", "n_bytes", "n_unknown", "decodes"])

    return documents.select(key, "text").mapInArrow(of, f"{key} {kind}, ids array<int>, n_pieces long, ids_sha256 string, n_bytes long, n_unknown long, decodes boolean")
