"""Encoding of a corpus with a public byte-level BPE vocabulary, and streaming decoding.

Method: the merges are compiled into a finite-state transducer that is determinised lazily. A state is the
last token known for certain and the bytes still pending after it. Reading a byte extends the encoding of
the prefix: of the tokens that end at the byte exactly one is compatible with the last token before it.
A boundary is emitted as soon as every position at which a longer token could still begin agrees on it, so
the lookahead is bounded by the longest token. Transitions and finals are computed once and then looked up.

Defined edge cases: a null or empty text has an empty list of ids; strings of special tokens are ordinary
text; lone surrogates are encoded as the replacement character; texts of any length take linear time.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States and shortcuts kept by one worker; the tables are emptied when full, results do not depend on it.
MAX_STATES = 400_000
MAX_WORDS = 200_000
#: Pre-tokens longer than this are not kept as shortcuts.
WORD_BYTES = 64


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[bytes, bytes], int] = {(b"", b""): 0}
        self.states: list[tuple[bytes, bytes, list[bytes]]] = [(b"", b"", [b""])]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: dict[int, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging of a short piece by rank; only used to judge pairs of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        if not a:
            return self.merge(b) == [b] if (b"", b) not in self.pairs else self.pairs[(b"", b)]
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > MAX_STATES:
                self.pairs.clear()
            ok = self.pairs[(a, b)] = self.merge(a + b) == [a, b]
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last = self.states[state]
        text = pending + bytes([byte])
        n = len(text)
        for p in range(max(0, n - self.longest), n):  # longest token first
            token = text[p:]
            if token in self.ranks and self.compatible(last[p], token):
                break
        last = [*last, token]
        # positions where a token still to come may begin; all of them decide what is certain
        live = [p for p in range(n) if text[p:] in self.prefixes] + [n]
        chains = []
        for p in live:
            chain = [p]
            while chain[-1] > 0:
                chain.append(chain[-1] - len(last[chain[-1]]))
            chains.append(chain[::-1])
        sure = set(chains[0]).intersection(*chains[1:])
        cut = max(p for p in sure if p <= live[0])
        tokens, at = [], cut
        while at > 0:
            tokens.append(last[at])
            at -= len(last[at])
        known, rest = (last[cut], text[cut:]) if cut else (before, text)
        key = (known, rest)
        nxt = self.ids.get(key)
        if nxt is None:
            nxt = self.ids[key] = len(self.states)
            self.states.append((known, rest, [known, *last[cut + 1 :]]))
        return nxt, tuple(self.ranks[t] for t in reversed(tokens))

    def _final(self, state: int) -> tuple[int, ...]:
        _, pending, last = self.states[state]
        tokens, at = [], len(pending)
        while at > 0:
            tokens.append(last[at])
            at -= len(last[at])
        return tuple(self.ranks[t] for t in reversed(tokens))

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for b in piece:
            k = state << 8 | b
            m = moves.get(k)
            if m is None:
                m = moves[k] = self._step(state, b)
            state = m[0]
            if m[1]:
                out += m[1]
        f = self.finals.get(state)
        if f is None:
            f = self.finals[state] = self._final(state)
        out += f
        return out


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    """Pre-tokenising pattern plus transducer; whole pre-tokens seen before are one transition."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in self.split(text or ""):
            ids = words.get(w)
            if ids is None:
                ids = self.transducer.encode(w.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").encode() if not w.isascii() else w.encode())
                if len(w) <= WORD_BYTES:
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


def decode_stream(ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text pieces of a stream of ids; bytes of an unfinished character wait for the next id."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if piece := machine.decode(tokens[i]):
            yield piece
    if piece := machine.decode(b"", True):
        yield piece


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(data), pattern)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a vocabulary file: about a megabyte, whatever the corpus
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every document."""
    vocabulary = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value, pattern).encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, f"`{key}` bigint, ids array<int>")


def count_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns and ``n_tokens`` of every document, without moving the ids."""
    vocabulary = _vocabulary(df, path)
    kept = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value, pattern).encode
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], n], names=[*keep, "n_tokens"])

    schema = T.StructType([*kept.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of encoded documents; null ids give null text."""
    vocabulary = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in load_ranks(vocabulary.value).items()}
        for b in batches:
            texts = [None if x is None else "".join(decode_stream(x, tokens)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("bigint"), F.col(ids)).mapInArrow(run, f"`{key}` bigint, text string")
