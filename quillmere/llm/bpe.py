"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its own bytes exactly if every token encodes to itself and
every two neighbours, joined, encode to just these two. So the segmentations of a word are the paths
of a nondeterministic machine whose states are (last token, node of the vocabulary's trie): a byte
moves down the trie, and where a token ends a new one may begin if the two are compatible. The machine
is unambiguous, hence functional, and the subset construction with delayed output makes it
deterministic: a state holds the live paths with the output that they do not share yet, and an arc
emits what all of them share. Paths that begin a token at the same byte are one path, so a state has
no more members than the longest token has bytes, and output lags by at most that much. States and
arcs are built when first used and kept by the worker process.

Decoding runs the bytes of the ids through an incremental UTF-8 state machine, so text can be emitted
while ids arrive and sequences cut anywhere.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published word pattern of this tokenizer family, with white space spelled out by
# Unicode's White_Space property, since engines differ in what \s holds.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file travels to the executors in a broadcast; files beyond this are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Words and states a worker keeps; both are dropped and built anew beyond it. Results do not depend on it.
KEEP = 400_000


def read_vocabulary(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes from lines of ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """The encoder for single words (``word``) and texts (``encode``), and the decoder."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._trie: list[dict[int, int]] = [{}]
        self._ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = self._trie[node].get(byte)
                if child is None:
                    child = len(self._trie)
                    self._trie.append({})
                    self._ends.append(-1)
                    self._trie[node][byte] = child
                node = child
            self._ends[node] = rank
        self._fits: dict[tuple[int, int], bool] = {}
        self._arcs: dict[tuple, dict] = {}
        self.start = self._state((((), -1, 0),))
        self._words = _Words(self)
        self._find = regex.compile(WORD_PATTERN).findall
        self._find_ascii = re.compile(_ASCII_PATTERN).findall

    def merge(self, data: bytes) -> list[int]:
        """Encode by applying merges one by one; the definition the transducer is compiled from."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if left < 0:
                known = self.merge(self.bytes_of[right]) == [right]
            else:
                known = self._compatible(-1, right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._fits) >= KEEP:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def _state(self, members: tuple) -> dict:
        state = self._arcs.get(members)
        if state is None:
            if len(self._arcs) >= KEEP:
                self._arcs.clear()
                self._arcs[self.start["members"]] = self.start
                for byte in [k for k in self.start if k != "members"]:
                    del self.start[byte]
            state = self._arcs[members] = {"members": members}
        return state

    def _arc(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """Build the arc of ``state`` by ``byte``: the next state and what it emits."""
        following = []
        for pending, last, node in state["members"]:
            child = self._trie[node].get(byte)
            if child is None:
                continue
            if self._trie[child]:
                following.append((pending, last, child))
            token = self._ends[child]
            if token >= 0 and self._compatible(last, token):
                following.append((pending + (token,), token, 0))
        shared = following[0][0]
        for pending, _, _ in following[1:]:
            i = 0
            while i < len(shared) and i < len(pending) and shared[i] == pending[i]:
                i += 1
            shared = shared[:i]
        n = len(shared)
        arc = (self._state(tuple((pending[n:], last, node) for pending, last, node in following)), shared)
        state[byte] = arc
        return arc

    def steps(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one word's bytes, each as soon as it is certain."""
        state = self.start
        for byte in data:
            arc = state.get(byte) or self._arc(state, byte)
            state = arc[0]
            yield from arc[1]
        yield from next(pending for pending, _, node in state["members"] if node == 0)

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(self.steps(word.encode("utf-8")))

    def encode(self, text: str | None) -> Iterable[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return ()
        find = self._find_ascii if text.isascii() else self._find
        return chain.from_iterable(map(self._words.__getitem__, find(text)))

    def count(self, text: str | None) -> int:
        return 0 if not text else sum(map(len, map(self._words.__getitem__, (self._find_ascii if text.isascii() else self._find)(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decode_stream(self.bytes_of[i] for i in ids))


class _Words(dict):
    """Ids of words seen; long words go through the transducer each time."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self._machine = machine

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self._machine.word(word)
        if len(word) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[word] = ids
        return ids


def decode_stream(pieces: Iterable[bytes]) -> Iterator[str]:
    """Text from pieces of UTF-8 cut at any byte; each invalid maximal part becomes one U+FFFD.

    State: the bytes of the open character, how many are missing, and the range the next one may have.
    """
    held, missing, low, high = bytearray(), 0, 0x80, 0xBF
    for piece in pieces:
        out: list[str] = []
        for byte in piece:
            if missing:
                if low <= byte <= high:
                    held.append(byte)
                    missing, low, high = missing - 1, 0x80, 0xBF
                    if not missing:
                        out.append(held.decode("utf-8"))
                        held.clear()
                    continue
                out.append("\ufffd")
                held.clear()
                missing, low, high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                missing = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                held.append(byte)
            else:
                out.append("\ufffd")
        if out:
            yield "".join(out)
    if held:
        yield "\ufffd"


_machines: dict[int, Transducer] = {}


def machine(data: bytes) -> Transducer:
    """This process's transducer for a vocabulary."""
    key = hash(data)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(read_vocabulary(data))
    return _machines[key]


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data


def _with_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row ``(id, ids array<int>)`` for each row of ``df``, without a shuffle.

    Null and empty texts give an empty list. Texts are encoded whole, of whatever length. Repeated
    rows give repeated rows, null ids stay null, other columns are not read.
    """
    shipped = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = machine(shipped.value).encode
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                flat.extend(encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return _with_text(df, id_col, text_col).mapInArrow(run, schema)


def count_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id, n_tokens)`` for each row of ``df``; null and empty texts have 0."""
    shipped = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = machine(shipped.value).count
        for batch in batches:
            sizes = pa.array([count(text) for text in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[id_col, "n_tokens"])

    return _with_text(df, id_col, text_col).mapInArrow(run, schema)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id, text)`` from lists of ids; a null or empty list gives ''."""
    shipped = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = machine(shipped.value).decode
        for batch in batches:
            texts = pa.array([decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
