"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A text is escaped as the library does (a dummy prefix, spaces as U+2581) and cut where no piece of the
vocabulary can cross: before each run of U+2581, around line ends, and around characters that are in no piece.
Within a cut, Aho-Corasick gives the longest piece from every position. The encoder takes the longest piece that is
compatible with its left neighbour, falls back to shorter prefixes, and steps back where none fits, with
a bitfield of the positions known to lead nowhere. Two neighbours are compatible if merging them again in
rank order would bring back the same two pieces.

Runs of U+2581 are the one place where pieces share a score, so that the leftmost pair merges first; such
a run is merged in that order (`_space_run`).

Defined results: a null or empty text has no ids and decodes to ''; a character in no piece becomes its byte pieces;
ids depend on the text alone, so that repeated rows and row order do not matter; extra columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import freed, slices, text_buffer

SPACE = "▁"
#: Bytes of segments that a Python worker remembers; as many that were remembered before are kept once more. A task frees both at its end.
REMEMBERED_BYTES = 20 << 20
#: Neighbour pairs that it remembers, of about 100 bytes each.
REMEMBERED_PAIRS = 60_000


@dataclass(frozen=True)
class Vocabulary:
    """What the driver reads from a model file; sent to the executors, which need no file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[int, ...]
    bytes_from: dict[int, int]
    unknown: int


def load_vocabulary(model_path: str) -> Vocabulary:
    """Read a merge-type model with byte fallback, an identity normaliser and a dummy prefix."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.vocab_size())
    special = {i for i in ids if model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)}
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids),
        tuple(model.get_score(i) for i in ids),
        tuple(i for i in ids if i not in special),
        {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)},
        model.unk_id(),
    )


class Encoder:
    """The backtracking encoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        ids = {v.pieces[i]: i for i in v.normal}
        self.alphabet = {c for p in ids for c in p}
        if not self.alphabet <= ids.keys() or any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces must be made of single-character pieces and hold spaces at their front only")
        self.runs = {p: i for p, i in ids.items() if set(p) == {SPACE}}
        words = sorted((p for p in ids if p not in self.runs or p == SPACE), key=lambda p: -v.scores[ids[p]])
        merged = [v.scores[ids[p]] for p in words if len(p) > 1]
        if len(set(merged)) < len(merged):
            raise ValueError("pieces of equal score other than runs of spaces are not supported")
        self.rank = {ids[p]: r for r, p in enumerate(words)}
        self.text = {ids[p]: p for p in words}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self._split(words, ids)
        kept = [p for p in words if len(p) == 1 or ids[p] in self.parts]
        self.shorter = {}
        whole = {p: ids[p] for p in kept}
        for p in kept:
            self.shorter[ids[p]] = next((whole[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), None)
        self.automaton = ahocorasick.Automaton()
        for p in kept:
            self.automaton.add_word(p, (len(p), ids[p]))
        self.automaton.make_automaton()
        self.length = {i: len(p) for i, p in self.text.items()}
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.alphabet)))}])")
        self.compatible: dict[int, bool] = {}

    def _split(self, words: list[str], ids: dict[str, int]) -> None:
        """For each piece the pair whose merge makes it when it stands alone; a piece that no merge makes has none."""
        rank = {p: r for r, p in enumerate(words)}
        for piece in words:
            if len(piece) == 1:
                continue
            parts = list(piece)
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], 1 << 60))
                if parts[at] + parts[at + 1] not in rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                pair = ids[parts[0]], ids[parts[1]]
                self.parts[ids[piece]] = pair
                self.pairs[pair] = ids[piece]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the two again, in rank order, never joins anything across their border."""
        rank, parts, pairs = self.rank, self.parts, self.pairs
        below = 1 << 60
        while True:
            joined = pairs.get((left, right))
            if joined is not None and rank[joined] < below:
                return False
            undo_left, undo_right = left in parts, right in parts
            # The merge that came last is undone first; what joins across must have a lower rank than it.
            if undo_left and (not undo_right or rank[left] > rank[right]):
                below, left = rank[left], parts[left][1]
            elif undo_right:
                # A pair that starts further left wins among equals, so equal ranks count here.
                below, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def _word(self, word: str) -> list[int]:
        """Ids of a string over the alphabet that holds a space at its front only."""
        longest = [0] * len(word)
        for end, (n, i) in self.automaton.iter(word):
            longest[end + 1 - n] = i  # ends come in order, so the longest piece from a position is the last
        size, length, shorter, known = len(word), self.length, self.shorter, self.compatible
        out: list[int] = []
        failed = bytearray(size + 1)
        at, token, before = 0, longest[0], -1
        while True:
            end = at + length[token]
            fits = not failed[end]
            if fits and before >= 0:
                fits = known.get(before << 20 | token)
                if fits is None:
                    if len(known) >= REMEMBERED_PAIRS:
                        known.clear()
                    fits = known[before << 20 | token] = self._compatible(before, token)
            if fits:
                out.append(token)
                if end == size:
                    return out
                before, at, token = token, end, longest[end]
                continue
            token = shorter[token]
            while token is None:
                failed[at] = 1
                before = out.pop()
                at -= length[before]
                token, before = shorter[before], out[-1] if out else -1

    def _space_run(self, n: int) -> list[int]:
        """n single spaces, of which the leftmost pair that has a piece merges first."""
        sizes: list[int] = []
        piece = {len(p): i for p, i in self.runs.items()}
        for _ in range(n):
            sizes.append(1)
            # One more space on the right can only start merges at the right end; each moves them one to the left.
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in piece:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [piece[s] for s in sizes]

    def segment(self, segment: str) -> list[int]:
        """Ids of one cut of an escaped text."""
        rest = segment.lstrip(SPACE)
        spaces = len(segment) - len(rest)
        known = self.unknown.split(rest) if self.unknown.search(rest) else [rest]
        out: list[int] = []
        first = self._word(SPACE * bool(spaces) + known[0]) if known[0] else [self.runs[SPACE]] * bool(spaces)
        if spaces > 1:
            alone = first[0] == self.runs[SPACE]
            out += self._space_run(spaces - 1 + alone)
            first = first[alone:]
        out += first
        for k, part in enumerate(known[1:], 1):
            if k % 2:
                raw = part.encode("utf-8", "surrogatepass")
                out += [self.vocabulary.bytes_from.get(b, self.vocabulary.unknown) for b in raw]
            elif part:
                out += self._word(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin or end ids."""
        if not text:
            return []
        return [i for s in cuts(text) for i in self.segment(s)]


_CUTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def cuts(text: str) -> list[str]:
    """The escaped text, cut before runs of spaces and around line ends; no piece crosses a cut."""
    return _CUTS.findall(SPACE + text.replace(" ", SPACE))


class _Remembered(dict):
    """Ids of a segment as little-endian int32 bytes."""

    #: What a string, its ids and their place in the dictionary take besides their own bytes.
    EACH = 150

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            got = self.encoder.segment(segment)
            ids = pack(f"<{len(got)}i", *got)
        if len(segment) <= 64:
            self.held += self.EACH + 2 * len(segment) + len(ids)
            if self.held > REMEMBERED_BYTES:
                self.older = dict(self)
                super().clear()
                self.held = 0
            self[segment] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.older, self.held = {}, 0
        self.encoder.compatible.clear()


_ENCODER: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of one vocabulary, which a Python worker keeps: about 20 MB, by the vocabulary alone."""
    key = hash((vocabulary.pieces, vocabulary.scores))
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(vocabulary)
    return _ENCODER[key]


def surfaces(vocabulary: Vocabulary) -> pa.Array:
    """What each id adds to a decoded text, as bytes."""
    out = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
    normal = set(vocabulary.normal)
    for i in range(len(out)):
        if i not in normal:
            out[i] = b""
    for byte, i in vocabulary.bytes_from.items():
        out[i] = bytes([byte])
    out[vocabulary.unknown] = " ⁇ ".encode()
    return pa.array(out, pa.large_binary())


def decode_arrays(ids: pa.LargeListArray, vocabulary: Vocabulary, table: pa.Array) -> pa.Array:
    """Texts of lists of ids: pieces end to end, one leading space of the first piece dropped, bytes read as UTF-8."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, table.take(ids.values)), pa.scalar(b"", pa.large_binary()))
    leading = pc.starts_with(joined, pattern=b" ")
    starts, values, texts = ids.offsets.to_numpy(), ids.values.to_numpy(), joined.to_pylist()
    spaced = leading.to_pylist()
    out = []
    for k, raw in enumerate(texts):
        first = int(values[starts[k]]) if starts[k] < starts[k + 1] else None
        if spaced[k] and vocabulary.pieces[first].startswith(SPACE):
            raw = raw[1:]
        try:
            out.append(raw.decode())
        except UnicodeDecodeError:
            out.append(_lossy(values[starts[k] : starts[k + 1]], vocabulary, table))
    return pa.array(out, pa.string())


def _lossy(ids: np.ndarray, vocabulary: Vocabulary, table: pa.Array) -> str:
    """Bytes that are no UTF-8 become one U+FFFD each, within each run of byte pieces."""
    is_byte, out, run = set(vocabulary.bytes_from.values()), [], b""
    for i in [*map(int, ids), None]:
        if i in is_byte:
            run += table[i].as_py()
            continue
        while run:
            for n in range(min(4, len(run)), 0, -1):
                try:
                    out.append(run[:n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            run = run[n:]
        if i is not None:
            out.append(table[i].as_py().decode())
    text = "".join(out)
    return text[1:] if len(ids) and vocabulary.pieces[int(ids[0])].startswith(SPACE) else text


def _encoded(column: pa.Array, remembered: _Remembered) -> pa.LargeListArray:
    rows = [b"".join([remembered[s] for s in cuts(t)]) if t else b"" for t in column.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode_decode(df: DataFrame, text: str, model_path: str, ids: str = "piece_ids", decoded: str = "piece_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` of df, with the ids of the text and the text decoded from these ids.

    No shuffle: each task encodes its own rows. Ids and text of a few megabytes at a time leave the worker.
    """
    vocabulary = load_vocabulary(model_path)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # about one megabyte: bounded by the vocabulary
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        table = surfaces(vocabulary)
        remembered = _Remembered(_encoder(vocabulary))
        try:
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                _, offsets = text_buffer(column)
                for a, b in slices(offsets):
                    got = _encoded(column.slice(a, b - a), remembered)
                    texts = decode_arrays(got, vocabulary, table)
                    yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], got.cast(pa.list_(pa.int32())), texts], names=[*keep, ids, decoded])
        finally:
            remembered.clear()
            freed()

    return source.mapInArrow(encode, schema)


def decode(df: DataFrame, ids: str, model_path: str, decoded: str = "piece_text") -> DataFrame:
    """df with the text of its column of id lists; null ids give null, ids out of range raise an error."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    @F.pandas_udf(T.StringType())
    def texts(column):
        import pandas as pd

        vocabulary = shared.value
        lists = pa.array([None if x is None else list(x) for x in column], pa.large_list(pa.int32()))
        out = decode_arrays(lists.fill_null([]), vocabulary, surfaces(vocabulary)).to_pandas()
        return pd.Series(out.where(~pd.Series(column).isna().to_numpy(), None))

    return df.withColumn(decoded, texts(F.col(ids)))
