"""SentencePiece encoding and decoding by backtracking (operator 13).

A piece model of the merge type joins, again and again, the adjacent pair whose concatenation is the
piece of highest score, the leftmost of equals. ``Encoder`` finds the same pieces from left to right
without merging the text. At each place it takes the longest piece that an Aho-Corasick automaton
matched there; if that piece cannot stand after the one before, the next shorter one; if none can, the
place is marked as failed in a bitfield and the piece before is taken back. Two adjacent pieces are
compatible if merging their concatenation anew gives exactly these two (remembered per pair, up to a
bound). Each place fails at most once, so the work is linear in the text.

No piece spans a cut before a white space mark that follows another character, nor one beside a
character that occurs in no longer piece (a digit, a line end, characters that the model does not
know). Texts are therefore cut there and each distinct word is encoded once per task (a bounded cache;
words past the bound are encoded again). Unknown characters become byte pieces.

Plan: one map stage without a shuffle; a task holds one slice of an Arrow batch and the cache.

A null text counts as empty and has no ids, and decodes to an empty text. Repeated rows are encoded
alike; a null doc_id stays null; further columns are not carried along, whatever their names. An empty
table gives an empty result. Models with a normalisation table, user-defined or unused pieces, or
without byte fallback are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

MARK = "▁"           # stands for a space
CACHE_WORDS = 300_000     # words remembered by a task
CACHE_CHARS = 64          # longer words are not remembered
CACHE_PAIRS = 500_000     # pairs of pieces remembered by a task
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6   # kinds of pieces (fixed values of the file format)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at:at + size]
        at += size


class Model:
    """What encoding and decoding need of a model file: ``score`` and ``ids`` of the normal pieces,
    ``surface`` (the bytes an id decodes to), ``byte_ids``, ``is_byte`` and ``prefix`` (whether a
    mark is put before a text)."""

    def __init__(self, raw: bytes):
        parts = list(_fields(raw))
        spec = {3: 1, 4: 1, 5: 1} | {k: v for n, m in parts if n == 3 for k, v in _fields(m)}
        merges = any(k == 3 and v == 2 for n, m in parts if n == 2 for k, v in _fields(m))
        if not merges or spec.get(2) or spec[4] or not spec[5]:
            raise ValueError("only merge-type models without normalisation are supported")
        self.prefix = bool(spec[3])
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.is_byte: list[bool] = []
        self.unknown: list[bool] = []
        byte_ids = {}
        for i, m in enumerate(m for n, m in parts if n == 1):
            f = dict(_fields(m))
            piece, kind = f.get(1, b"").decode(), f.get(3, NORMAL)
            self.is_byte.append(kind == BYTE)
            self.unknown.append(kind == UNKNOWN)
            if kind == NORMAL:
                self.ids[piece] = i
                self.score[piece] = float(np.frombuffer(f.get(2, b"\0" * 4), dtype="<f4")[0])
                self.surface.append(piece.replace(MARK, " ").encode())
            elif kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                self.surface.append(b"" if kind == CONTROL else " ⁇ ".encode())
            else:
                raise ValueError("models with user-defined or unused pieces are not supported")
        if len(byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.byte_ids = [byte_ids[b] for b in range(256)]


def merge(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Join the adjacent pair that makes the piece of highest score, the leftmost first."""
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return symbols
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]


class Encoder:
    """Words to pieces by backtracking. A character that the model lacks is a piece of its own."""

    def __init__(self, model: Model, reached: list[str] | None = None):
        self.model, self.score = model, model.score
        # a piece that merging its own characters does not give never comes up in a text
        if reached is None:
            reached = [p for p in model.score if len(p) == 1 or merge(list(p), model.score) == [p]]
        self.reached = reached
        known = set(reached)
        self.longest = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}
        for p in reached:
            if len(p) > 1:
                self.longest.add_word(p, p)
                self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in known), p[0])
        self.longest.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        inner = "".join(sorted({c for p in model.score if len(p) > 1 for c in p} - {MARK}))
        # the cut before a mark holds only if no piece has a mark after another character
        whole = any(MARK in p.lstrip(MARK) for p in model.score)
        body = f"[{re.escape(inner)}]+"
        self.find = re.compile(f"[{MARK}{re.escape(inner)}]+|." if whole else f"{MARK}*{body}|{MARK}+|.", re.DOTALL).findall

    def words(self, text: str) -> list[str]:
        """The independent words of a text, marks in place of spaces."""
        return self.find((MARK if self.model.prefix else "") + text.replace(" ", MARK)) if text else []

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two pieces' characters gives these two pieces."""
        known = self.pairs.get((a, b))
        if known is None:
            known = merge(list(a + b), self.score) == [a, b]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def split(self, word: str) -> list[str]:
        """The pieces of a word."""
        size = len(word)
        if size == 1:
            return [word]
        longest = list(word)
        for end, piece in self.longest.iter(word):      # matches with a later end are longer
            longest[end + 1 - len(piece)] = piece
        failed = bytearray(size + 1)
        shorter, compatible = self.shorter, self.compatible
        out: list[str] = []
        at, piece = 0, longest[0]
        while True:
            last = out[-1] if out else None
            while failed[at + len(piece)] or last is not None and not compatible(last, piece):
                piece = shorter.get(piece)
                if piece is None:
                    break
            if piece is not None:
                out.append(piece)
                at += len(piece)
                if at == size:
                    return out
                piece = longest[at]
            else:                                         # nothing fits here: take the last piece back
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)

    def encode(self, word: str) -> list[int]:
        ids = self.model.ids
        out = []
        for p in self.split(word):
            i = ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.model.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
        return out


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def decode_ids(model: Model, ids: list[int]) -> str:
    """The text of any list of ids. Bytes that form no character become U+FFFD one by one."""
    out, run, first = [], bytearray(), model.prefix

    def close():
        at = 0
        while at < len(run):
            size = next((n for n in range(1, 5) if _is_char(run[at:at + n])), 0)
            out.append(run[at:at + size].decode() if size else "�")
            at += size or 1
        run.clear()

    for i in ids:
        if model.is_byte[i]:
            run += model.surface[i]
            continue
        close()
        first = first and not any(out)
        s = model.surface[i].decode()
        if first and s.startswith(" ") and not model.unknown[i]:
            first, s = False, s[1:]
        out.append(s)
    close()
    return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _surfaces(model: Model) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(model.surface), dtype=np.uint8),
            np.concatenate([[0], np.cumsum([len(s) for s in model.surface])]))


def _decode(model: Model, ids: np.ndarray, surface: np.ndarray, at: np.ndarray) -> str:
    """``decode_ids`` at the speed of array operations where the bytes are a valid text."""
    n = at[ids + 1] - at[ids]
    raw = surface[np.arange(int(n.sum())) + np.repeat(at[ids] - (np.cumsum(n) - n), n)].tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return decode_ids(model, ids.tolist())
    odd = len(ids) and (model.is_byte[ids[0]] or not n[0] or model.unknown[ids[0]])
    if odd or not model.prefix:
        return decode_ids(model, ids.tolist())
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (the text of these ids) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = read_model(model_path)
    reached = Encoder(Model(raw)).reached                 # found once; refuses here what it doesn't support

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(raw)
        encoder = Encoder(model, reached)
        surface, at = _surfaces(model)
        cache: dict[str, bytes] = {}
        words, code = encoder.words, encoder.encode

        def ids_of(text: str) -> np.ndarray:
            found = []
            for w in words(text):
                ids = cache.get(w)
                if ids is None:
                    ids = np.array(code(w), dtype=np.int32).tobytes()
                    if len(w) <= CACHE_CHARS and len(cache) < CACHE_WORDS:
                        cache[w] = ids
                found.append(ids)
            return np.frombuffer(b"".join(found), dtype=np.int32)

        for batch in batches:
            for part in slices(batch, 1):
                ids = [ids_of(t or "") for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array([_decode(model, x, surface, at) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, ids array<int>, decoded string")
