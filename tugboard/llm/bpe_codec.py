"""Byte-level BPE in linear time by going back instead of merging, and decoding through an offset table.

A row of tokens is what the merges give exactly if each two neighbours are compatible: seen from the
place where they meet, no merge across it comes before those that made the two. So a piece of text is
walked once. One Aho-Corasick pass finds the longest token that begins at each place. If it cannot
stand beside the token before it, the next shorter one is tried; if none can, the token before is given
up for a shorter one. A mark per place remembers dead ends, so none is entered twice.

Which tokens may be neighbours is worked out from the merges once per pair and kept in a table. How a
text is cut into pieces, and which strings are special tokens, is read from the tokenizer's file.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from tokenizers import Tokenizer

from tugboard.llm.shared import bounded_batches, fresh, ragged, widened, worker_state

# Fixed value: Unicode's white space. No piece of a text reaches over the end of a run of it and what
# follows, so such chunks can be encoded one by one and remembered.
WHITE = r"\t-\r \x85\xa0  -     　"
CHUNK = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

# Fixed value: how the tokenizer cuts a text into pieces. Which characters are letters depends on the
# version of Unicode, so only texts below FIRST_DOUBTFUL are cut here, others by the library itself.
PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
FIRST_DOUBTFUL = "\u0530"

KNOWN_CHUNKS = 500_000     # what a worker remembers before it starts anew
KNOWN_IDS = 4_000_000
KNOWN_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary's strings."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one byte-level BPE tokenizer file without normalizer or template."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        if described["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only tokenizers that cut texts in the byte-level way are known here")
        self.library_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        atoms = byte_letters()
        as_bytes = str.maketrans({letter: chr(byte) for letter, byte in atoms.items()})

        def spelled_out(text: str) -> str:
            """The bytes of a vocabulary string, as characters of the same numbers."""
            return text.translate(as_bytes)

        vocabulary = {spelled_out(text): token for text, token in described["model"]["vocab"].items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(vocabulary.values(), -1)
        for rank, (left, right) in enumerate(described["model"]["merges"]):
            left, right = spelled_out(left), spelled_out(right)
            made = vocabulary[left + right]
            self.merge.setdefault((vocabulary[left], vocabulary[right]), rank)
            if made not in self.halves:
                self.halves[made] = vocabulary[left], vocabulary[right]
                self.rank[made] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token can be the result of merges only if its halves are, and stay apart until its own merge.
        usable = {token for text, token in vocabulary.items() if len(text) == 1}
        for made in sorted(self.halves, key=self.rank.get):
            left, right = self.halves[made]
            if left in usable and right in usable and self._stay_apart(left, right, self.rank[made]):
                usable.add(made)
        self.length = {token: len(text) for text, token in vocabulary.items()}
        self.longest = ahocorasick.Automaton()
        self.shorter: dict[int, int | None] = {}
        for text, token in vocabulary.items():
            if token in usable:
                self.longest.add_word(text, token)
                starts = (vocabulary.get(text[:n]) for n in range(len(text) - 1, 0, -1))
                self.shorter[token] = next((x for x in starts if x in usable), None)
        self.longest.make_automaton()
        special = {entry["content"]: entry["id"] for entry in described["added_tokens"]}
        self.special = special
        self.find_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        size = max([*vocabulary.values(), *special.values()]) + 1
        spelled = [b""] * size
        for text, token in vocabulary.items():
            spelled[token] = text.encode("latin-1")
        for text, token in special.items():
            spelled[token] = text.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        lengths = np.array([len(x) for x in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self._forget()

    def _stay_apart(self, a: int, b: int, before: float) -> bool:
        """Whether no merge that comes earlier than ``before`` crosses from ``a`` to ``b``.

        Undoes the merges that made the two, latest first, and looks at what then touches. Of equal
        merges the left one comes first, hence the two different bounds.
        """
        rank, merge = self.rank, self.merge
        while True:
            if merge.get((a, b), before) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.halves[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.halves[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stay_apart(a, b, float("inf"))
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of a piece, given as one character per byte."""
        begins: list[int] = [0] * len(piece)
        length = self.length
        for end, token in self.longest.iter(piece):  # by place of the end, so the longest comes last
            begins[end + 1 - length[token]] = token
        tokens: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, begins[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at = end
                if at == len(piece):
                    return tokens
                token = begins[at]
                continue
            shorter = self.shorter[token]
            while shorter is None:
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
                shorter = self.shorter[token]
            token = shorter

    def encode_plain(self, text: str) -> list[int]:
        if text.isascii() or text and max(text) < FIRST_DOUBTFUL:
            pieces = PIECE.findall(text)
        else:
            pieces = [text[begin:end] for _, (begin, end) in self.library_cut(text)]
        tokens = []
        for piece in pieces:
            known = self.pieces.get(piece)
            if known is None:
                known = self.pieces[piece] = self.encode_piece(piece.encode().decode("latin-1"))
            tokens += known
        return tokens

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk, in which the strings of special tokens stand for these."""
        found, at = [], 0
        if self.find_special is None or not self.find_special.search(chunk):
            return self.encode_plain(chunk)
        for match in self.find_special.finditer(chunk):
            found += self.encode_plain(chunk[at: match.start()])
            found.append(self.special[match.group()])
            at = match.end()
        return found + self.encode_plain(chunk[at:])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.known_ids, self.known_ends, self.known_text = array("i"), array("q", [0]), []

    def _numbers(self, chunks: list[str]) -> list[int]:
        known = self.known
        numbers = list(map(known.get, chunks))
        if None in numbers:
            for k, number in enumerate(numbers):
                if number is None:
                    chunk = chunks[k]
                    number = known.get(chunk)
                    if number is None:
                        ids = self.encode_chunk(chunk)
                        self.known_ids.extend(ids)
                        self.known_ends.append(len(self.known_ids))
                        self.known_text.append(",".join(map(str, ids)))
                        number = known[chunk] = len(known)
                    numbers[k] = number
        return numbers

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """For each text its ids, and the same written out in decimal with commas."""
        if len(self.known) > KNOWN_CHUNKS or len(self.known_ids) > KNOWN_IDS:
            self._forget()
        numbered = [self._numbers(CHUNK.findall(text)) for text in texts]
        written = [",".join([self.known_text[n] for n in numbers]) for numbers in numbered]
        ids, ends = np.array(self.known_ids, np.int32), np.array(self.known_ends, np.int64)
        found = []
        for numbers in numbered:
            chosen = np.array(numbers, np.int64)
            found.append(ids[ragged(ends[chosen], ends[chosen + 1] - ends[chosen])])
        return found, written

    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        return self.bytes[ragged(starts, self.offsets[ids + 1] - starts)].tobytes()


def codec(path: str) -> Codec:
    """The codec of this worker; its tables are built once per worker and file."""
    state = worker_state()
    if ("bpe", path) not in state:
        state["bpe", path] = Codec(path)
    return state["bpe", path]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids. Null is encoded like an empty text, as no ids.

    ``tokenizer`` is the path of a tokenizer file that every executor has. Texts are encoded whole; the
    strings of special tokens become those. ``ids`` must be a free name.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = codec(tokenizer).encode_all(_texts(batch.column(at)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return docs.mapInArrow(encode, widened(docs, **{ids: ArrayType(IntegerType())}))


def decode_ids(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids spell; bytes that are no UTF-8 become U+FFFD. Null ids spell nothing."""
    bounded_batches(rows.sparkSession)
    at = rows.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = [codec(tokenizer).decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelled, pa.string())], [*batch.schema.names, text])

    return rows.mapInArrow(decode, widened(rows, **{text: StringType()}))


def round_trip(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row: both directions in one pass over the texts.

    The digests are those of the decimal ids joined by commas and of the decoded text. Null counts as an
    empty text; repeated rows come back as often as they came; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    (name,) = fresh(["n_tokens", "ids_sha256", "decoded_sha256"], id)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, written = codec(tokenizer).encode_all(_texts(batch.column(1)))
            decoded = [codec(tokenizer).decode(x).decode("utf-8", "replace").encode() for x in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in written], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ], [name, "n_tokens", "ids_sha256", "decoded_sha256"])

    taken = docs.select(F.col(id).cast("bigint").alias(name), F.col(text).alias("_text"))
    return taken.mapInArrow(both, f"`{name}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
