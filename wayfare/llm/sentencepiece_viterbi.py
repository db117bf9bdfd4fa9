"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton holds all pieces. While it reads a text once, each state's output links give every piece
that ends at the position, and each of them relaxes the best score there. Pieces never run from a letter
into a following space and never hold a line end, so the best segmentation of a text is that of its
stretches (spaces with the letters behind them) one after another, and stretches met before in a task
are looked up.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches of a generation of those that a task remembers, and bytes of the slices in which documents are coded.
MEMO, BATCH = 60_000, 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces in place of the SentencePiece space mark, their scores, and the ids of the byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    bytes_at: int

    @staticmethod
    def read(path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read a model with byte pieces by the sentencepiece library, on the driver; it holds some ten thousand pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = tuple(not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids)
        pieces = tuple(model.id_to_piece(i).replace("▁", " ") if plain[i] else model.id_to_piece(i) for i in ids)
        if any(p and ((" " in p.lstrip(" ")) or "\n" in p) for p, ok in zip(pieces, plain, strict=True) if ok):
            raise ValueError("a piece with a space behind a letter, or with a line end")
        return Vocabulary(pieces, tuple(model.get_score(i) for i in ids), plain, model.piece_to_id("<0x00>"))


class Decoder:
    """Turns piece ids into text; needs the pieces alone."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_at = lo = vocabulary.bytes_at
        # a byte piece of ASCII is a character of its own
        self.pieces = [chr(i - lo) if lo <= i < lo + 128 else p for i, p in enumerate(vocabulary.pieces)]

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        ids, lo, hi, pieces = np.asarray(ids, np.int32), self.bytes_at, self.bytes_at + 256, self.pieces
        raw = (ids >= lo + 128) & (ids < hi)
        if not raw.any():
            return "".join([pieces[i] for i in ids.tolist()]).removeprefix(" ")
        cuts = np.flatnonzero(raw[1:] != raw[:-1]) + 1
        parts = []
        for run in np.split(ids, cuts):
            if lo + 128 <= run[0] < hi:
                parts.append((run - lo).astype(np.uint8).tobytes().decode("utf-8", "surrogatepass"))
            else:
                parts.append("".join([pieces[i] for i in run.tolist()]))
        return "".join(parts).removeprefix(" ")


class Codec(Decoder):
    """Encodes and decodes texts; built once for each task from a broadcast Vocabulary.

    A leading space is added before encoding and taken off in decoding. A character that is no piece
    costs 10 more than the worst piece and becomes the byte pieces of its UTF-8, so every text comes
    back exactly (a literal space mark too, since it is not a piece here). Of two ways with equal
    scores, the one with the longer last piece is taken. The ids of short stretches are remembered as
    bytes, in two generations of MEMO stretches each: what was not met again in a generation goes.
    """

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__(vocabulary)
        self.automaton = ahocorasick.Automaton()
        single = set()
        for i, (p, score, plain) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.plain, strict=True)):
            if plain and p and p not in self.automaton:
                self.automaton.add_word(p, (len(p), score, i))
                if len(p) == 1:
                    single.add(p)
        self.automaton.make_automaton()
        self.single = frozenset(single)
        self.unknown = min(s for s, plain in zip(vocabulary.scores, vocabulary.plain, strict=True) if plain) - 10
        self.line_end = np.int32(vocabulary.bytes_at + 10).tobytes()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text without line ends, by one pass of the automaton."""
        best, last = [0.0], []  # by position: the best score up to it, and the (length, id) of its last piece
        reached, strange = 0, not self.single.issuperset(text)

        def bridge(to: int) -> None:
            """Positions up to `to`, as far as no piece ended there, and unknown characters."""
            for at in range(reached, to):
                if text[at] not in self.single:
                    score = best[at] + self.unknown
                    if len(best) == at + 1:
                        best.append(score)
                        last.append((1, -1))
                    elif score > best[at + 1]:
                        best[at + 1], last[at] = score, (1, -1)

        for end, (length, score, i) in self.automaton.iter(text):
            if strange and reached < end:
                bridge(end)
                reached = end
            total = best[end + 1 - length] + score
            if len(best) == end + 1:
                best.append(total)
                last.append((length, i))
            elif total > best[end + 1]:
                best[end + 1], last[end] = total, (length, i)
        if strange:
            bridge(len(text))
        ids: list[int] = []
        at = len(text)
        while at:
            length, i = last[at - 1]
            if i < 0:
                ids.extend(self.bytes_at + b for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(i)
            at -= length
        ids.reverse()
        return ids

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch as 32-bit numbers."""
        ids = self.memo.get(text) or self.older.get(text) or array("i", self.viterbi(text)).tobytes()
        if len(text) <= 32:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        out: list[bytes] = []
        for k, line in enumerate((" " + text).split("\n")):
            if k:
                out.append(self.line_end)
            head, *rest = line.split(" ")
            if head:
                out.append(self.stretch(head))
            spaces = ""
            for word in rest:
                if word:
                    word = f"{spaces} {word}"
                    out.append(self.memo.get(word) or self.stretch(word))
                    spaces = ""
                else:
                    spaces += " "
            if spaces:
                out.append(self.stretch(spaces))
        return np.frombuffer(b"".join(out), np.int32)


def _mapped(df: DataFrame, column: str, added: dict[str, T.DataType], build) -> DataFrame:
    """df with further columns that build() makes from slices of another one of BATCH characters or so; columns of those names are replaced."""
    df = df.drop(*[c for c in df.columns if c.lower() in {x.lower() for x in added} and c != column])
    at, names = df.columns.index(column), df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    new = [f"added{i}" for i in range(len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = build()
        for whole in batches:
            step = max(1, whole.num_rows * BATCH // max(whole.nbytes, 1))
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*b.columns, *make(b.column(at))], names=[*b.schema.names, *new])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *(T.StructField(n, kind) for n, kind in zip(new, added.values(), strict=True))])).toDF(*names, *added)


def _id_lists(coded: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in coded)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(x is None for x in coded), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *(x for x in coded if x is not None)])))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the array of piece ids of its text. Null texts have null ids, empty ones an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the model

    def build():
        codec = Codec(shared.value)
        return lambda texts: [_id_lists([codec.encode(t.as_py()) if t.is_valid else None for t in texts])]

    return _mapped(docs, text_col, {ids_col: T.ArrayType(T.IntegerType())}, build)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """coded with the text of its piece ids. Null ids have a null text, no ids the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def build():
        decoder = Decoder(shared.value)
        return lambda lists: [pa.array([decoder.decode(x.values.to_numpy()) if x.is_valid else None for x in lists], pa.string())]

    return _mapped(coded, ids_col, {text_col: T.StringType()}, build)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """docs with the piece ids of its text and whether decoding them gives the text again; null texts have null ids and are the same.

    Both directions run in one pass of one task, so that only the ids leave it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build():
        codec = Codec(shared.value)

        def make(texts: pa.Array) -> list[pa.Array]:
            coded, same = [], []
            for text in texts:
                text = text.as_py()
                ids = None if text is None else codec.encode(text)
                coded.append(ids)
                same.append(text is None or codec.decode(ids) == text)
            return [_id_lists(coded), pa.array(same, pa.bool_())]

        return make

    return _mapped(docs, text_col, {ids_col: T.ArrayType(T.IntegerType()), same_col: T.BooleanType()}, build)
