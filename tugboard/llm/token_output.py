"""Token ids in files: Huffman-coded blocks in the order of the documents, and reading them back.

The documents are dealt out in ranges of their ids, and each range is put in order and tokenized once;
its ids are written down in blocks, compressed as they are. The counts of all these give one canonical
code for the whole output, and the blocks are coded with it where they lie.

The format: a folder with two Parquet tables. ``code`` has the length of each id's code, which is all a
canonical code needs. ``blocks`` has rows that can each be read alone:

    file      number of the range the block is in; ranges are in order
    block     place of the block in its range
    before    ids of the range that stand before the block
    doc_ids   the documents in the block, in order
    counts    the number of ids of each
    offsets   the bit at which every SPACING-th id begins
    bits      the codes, most significant bit first

Spark writes and commits the files, so a lost executor leaves no half of one, and any store will do.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tugboard.llm.huffman import Code, code_lengths
from tugboard.llm.shared import bounded_batches, ragged, stored, worker_state

BLOCKS = "file int, block int, before bigint, doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, bits binary"
BLOCK_IDS = 1 << 16       # a block is closed by the document that reaches it
BLOCKS_AT_ONCE = 16
FIRST_UNSURE = "\u0250"   # below it no letter changes by normalization
KNOWN_CHUNKS = 1_500_000  # what a worker remembers before it starts anew
WORDS_AT_ONCE = 1000      # words the library is given in one line


@dataclass(frozen=True)
class TokenRule:
    tokenizer: str
    end_id: int = 1


class Words:
    """Ids of whole texts by the tokenizers library, which is asked once per stretch between spaces.

    For tokenizers that drop white space: then no token, merge or normal form reaches over a space or a
    line end. ``tests/llm`` holds the ids against those of whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cutter = Tokenizer.from_file(path)
        self.cutter.normalizer = None
        # Words of letters need no expression to be cut; the probes below tell if the bytes are meant so.
        self.cutter.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # Ids that end a word, for vocabularies that mark them: then words can be asked for by the line.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.final[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        marks = {mark: array("i", self.tokenizer.encode(mark, add_special_tokens=False).ids) for mark in ".,;:!?"}
        self.marks = {mark: ids for mark, ids in marks.items() if len(ids) == 1}
        # Whether the steps skipped do to plain words what is taken for granted here.
        self.lowers = all(
            self.tokenizer.encode(word + mark, add_special_tokens=False).ids
            == self.cutter.encode(word.lower(), add_special_tokens=False).ids + ids.tolist()
            for word in ("Word", "ÉTÉ", "straßeÑ") for mark, ids in self.marks.items()
        )
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def _learn(self, new: list[str]) -> None:
        """Asks the library for the ids of ``new``. A word of plain letters, with a mark behind it or not, is
        already in normal form but for its case and is one piece, so the library can skip these steps."""
        known, marks, ids, ends = self.known, self.marks, self.ids, self.ends
        letters, variants, others = set(), [], []
        for chunk in new:
            if chunk.isalpha():
                word, mark = chunk, ""
            elif chunk[:-1].isalpha() and chunk[-1] in marks:
                word, mark = chunk[:-1], chunk[-1]
            else:
                others.append(chunk)
                continue
            lowered = word.lower()
            if not self.lowers or not word.isascii() and (max(word) >= FIRST_UNSURE or not lowered.isalpha()):
                others.append(chunk)
                continue
            if lowered not in known:
                letters.add(lowered)
            if lowered != chunk:
                variants.append((chunk, lowered, mark))
        singly = [(self.tokenizer, others)]
        words = list(letters)
        for begin in range(0, len(words), WORDS_AT_ONCE):
            some = words[begin: begin + WORDS_AT_ONCE]
            found = np.array(self.cutter.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.final[found]) + 1
            if len(cuts) != len(some):
                singly.append((self.cutter, some))
                continue
            known.update(zip(some, range(len(ends) - 1, len(ends) - 1 + len(some))))
            ends.frombytes((cuts + len(ids)).astype(np.int64).tobytes())
            ids.frombytes(found.tobytes())
        for tokenizer, part in singly:
            for begin in range(0, len(part), 10_000):
                some = part[begin: begin + 10_000]
                for chunk, encoded in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                    known[chunk] = len(ends) - 1
                    ids.extend(encoded.ids)
                    ends.append(len(ids))
        marked = []
        for chunk, lowered, mark in variants:
            if mark:
                marked.append((chunk, known[lowered], mark))
            else:
                known[chunk] = known[lowered]
        if marked:
            self._mark(marked)

    def _mark(self, marked: list[tuple[str, int, str]]) -> None:
        """Words whose ids are known, each with a mark of one id behind it."""
        ids, ends = np.frombuffer(self.ids, np.int32), np.frombuffer(self.ends, np.int64)
        chunks, numbers, signs = zip(*marked)
        numbers = np.array(numbers)
        lengths = ends[numbers + 1] - ends[numbers]
        upto = np.cumsum(lengths)
        behind = np.array([self.marks[sign][0] for sign in signs], np.int32)
        more = np.insert(ids[ragged(ends[numbers], lengths)], upto, behind).astype(np.int32)
        first, base = len(ends) - 1, len(ids)
        del ids, ends   # arrays that are looked at cannot grow
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.ids.frombytes(more.tobytes())
        self.ends.frombytes((upto + np.arange(1, len(chunks) + 1) + base).astype(np.int64).tobytes())

    def encode(self, texts: pa.Array | list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another and each with the end id behind it, and how many each has.

        Stretches are cut and told apart by Arrow, so only the different ones of a batch are looked up here.
        """
        if len(self.known) > KNOWN_CHUNKS:
            self._forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        chunked = pc.split_pattern(pc.replace_substring(column.fill_null(""), "\n", " "), " ")
        sizes = np.diff(chunked.offsets.to_numpy()).astype(np.int64)
        coded = chunked.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, chunks))
        open_ = [at for at, number in enumerate(found) if number is None]
        if open_:
            self._learn([chunks[at] for at in open_])
            for at in open_:
                found[at] = self.known[chunks[at]]
        numbers = np.array(found, np.int64)
        chosen = numbers[coded.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int64)
        ids, ends = np.frombuffer(self.ids, np.int32) if len(self.ids) else np.zeros(0, np.int32), np.frombuffer(self.ends, np.int64)
        lengths = ends[chosen + 1] - ends[chosen]
        flat = ids[ragged(ends[chosen], lengths)]
        counts = np.add.reduceat(lengths, np.cumsum(sizes) - sizes) if len(sizes) else sizes  # a text has one stretch at least
        return np.insert(flat, np.cumsum(counts), end_id), counts + 1


def words_of(path: str) -> Words:
    state = worker_state()
    if ("words", path) not in state:
        state["words", path] = Words(path)
    return state["words", path]


def ordered_ids(docs: DataFrame, id: str, text: str, rule: TokenRule) -> DataFrame:
    """Blocks as in the format, but with the plain ids in ``bits`` and no ``offsets``."""
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(rule.tokenizer)
        file, block, before = TaskContext.get().partitionId(), 0, 0
        docs_now, counts_now, ids_now, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            bits = zstandard.compress(np.concatenate(ids_now).astype(words.kind).tobytes(), 1)
            return _block(file, block, before, docs_now, counts_now, [], bits)

        for batch in batches:
            docs, (flat, counts) = batch.column(0).to_pylist(), words.encode(batch.column(1), rule.end_id)
            ends, begin = np.cumsum(counts), 0
            while begin < len(docs):
                done = int(ends[begin - 1]) if begin else 0
                end = min(len(docs), int(np.searchsorted(ends, done + BLOCK_IDS - size)) + 1)
                docs_now += docs[begin:end]
                counts_now += counts[begin:end].tolist()
                ids_now.append(flat[done: ends[end - 1]])
                size, begin = size + int(ends[end - 1]) - done, end
                if size >= BLOCK_IDS:
                    yield closed()
                    block, before = block + 1, before + size
                    docs_now, counts_now, ids_now, size = [], [], [], 0
        if docs_now:
            yield closed()

    taken = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return taken.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(tokenize, BLOCKS)


def _block(*values) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    names = [field.split()[0] for field in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def _plain(bits: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bits), kind)


def id_counts(plain: DataFrame, kind) -> DataFrame:
    """``id, count`` over the blocks of ``ordered_ids``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for bits in batch.column(0):
                here = np.bincount(_plain(bits.as_py(), kind), minlength=len(total))
                here[: len(total)] += total
                total = here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "count"])

    return plain.select("bits").mapInArrow(count, "id bigint, count bigint").groupBy("id").agg(F.sum("count").alias("count"))


def write_tokens(docs: DataFrame, path: str, rule: TokenRule, id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts, each with the end id behind it, to the folder ``path``.

    Documents are in ascending order of id, those without an id first; of equal ids in the order of
    their texts. Null texts are empty: the end id alone. A table without rows gives empty tables.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = Words(rule.tokenizer).kind
    plain = stored(ordered_ids(docs, id, text, rule))
    counted = id_counts(plain, kind).collect()  # a row per id of the vocabulary at most
    counts = np.zeros(max([rule.end_id, *[r["id"] for r in counted]]) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts)
    code_rows = [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)]
    spark.createDataFrame(code_rows, "id bigint, length int").coalesce(1).write.parquet(f"{path}/code")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                bits, offsets = code.encode(_plain(r["bits"], kind))
                yield _block(r["file"], r["block"], r["before"], r["doc_ids"], r["counts"], offsets.tolist(), bits)

    plain.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document in the folder, and ``ids`` if wanted.

    ``start`` is the number of ids of all documents before; the checksum is that of the ids as
    little-endian unsigned 32-bit numbers. Blocks are decoded wherever Spark reads them.
    """
    bounded_batches(spark)
    code_rows = spark.read.parquet(f"{path}/code").collect()  # a row per id of the vocabulary at most
    lengths = np.zeros(max([0, *[r["id"] for r in code_rows]]) + 1, np.uint8)
    for r in code_rows:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("file", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    per_file = sorted(tuple(r) for r in sizes.groupBy("file").agg(F.sum("n")).collect())  # a row per range
    starts = np.cumsum([0, *[n for _, n in per_file]]).tolist()
    base = {file: start for (file, _), start in zip(per_file, starts, strict=False)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for whole in batches:
            for first in range(0, len(whole), BLOCKS_AT_ONCE):
                rows = whole.slice(first, BLOCKS_AT_ONCE).to_pylist()
                found = code.decode([(r["bits"], r["offsets"], sum(r["counts"])) for r in rows])
                out: list[list] = [[], [], [], [], []]
                for r, ids in zip(rows, found, strict=True):
                    ids = ids.astype("<u4")
                    at = 0
                    for doc, count in zip(r["doc_ids"], r["counts"], strict=True):
                        own = ids[at: at + count]
                        values = (doc, base[r["file"]] + r["before"] + at, count, zlib.crc32(own), own if with_ids else None)
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                        at += count
                columns = [pa.array(x, pa.int64()) for x in out[:4]]
                if with_ids:
                    columns.append(pa.array(out[4], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = f"`{id}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return blocks.select("file", "before", "doc_ids", "counts", "offsets", "bits").mapInArrow(decode, schema)
