"""Token-id files: fixed-size id blocks, transposed into planes, each plane compressed, with a chunk index.

One file holds the documents of one range of doc_ids in ascending order. Ids are cut into blocks of BLOCK; a block's
ids, little-endian uint32, are transposed into 4 byte planes (or 32 bit planes) and each plane is compressed with
zstandard, so that planes of zeros or of slowly changing bytes cost next to nothing. The footer lists for each block
its place and its planes' sizes, and for each document its doc_id and where its ids begin.

    MAGIC | planes of block 0 | planes of block 1 | ... | footer (zstandard of JSON head and arrays) | length | MAGIC

A file is closed when its ids pass ROLL bytes on disk or FILE_DOCS documents, and the task goes on with the next. Each
attempt of a task writes files of its own; the rows that write_tokens returns name those of the attempts that count.

Defined results: null text counts as empty: its only id is the end id; a null doc_id comes before all others; rows of
equal doc_id are in order of a hash of their text, and exact repeats of a row are written each; an empty table gives no
file and an empty result; other columns are ignored; very long texts are encoded in pieces of a few MB, cut at white space.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import pieces, ragged, words_of
from .bpe import vocabulary_path
from .common import scratch, staged, table
from .hash_index import file_system

MAGIC, BLOCK, END = b"VXPLANE1", 1 << 16, 1
#: Words whose ids a worker remembers, bytes of text whose words are encoded together, and words of one call to the library.
REMEMBERED, BATCH, CALL = 600_000, 8 << 20, 200
#: Bytes, and documents, from which on a file is closed.
ROLL, FILE_DOCS = 256 << 20, 1_000_000
#: Letters and marks between which the vocabulary always cuts, so that words can be cut there. Not among the marks are the
#: apostrophe, which may begin an ending, and those of special tokens.
LETTER, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", r"[!-&(-;=?@\[-`{}~]"
#: Words of letters alone, or of marks alone: one piece each to the vocabulary. U+0130 has a lower case that isn't a letter.
WORD_END = "</w>"
ONE_PIECE = r"^(?:\pL+|[!-&(-/:;=?@\[-`{}~]+)$"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The 4 byte planes, or 32 bit planes, of uint32 ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if len(rows) == 32:
        rows = [np.packbits(np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows[k : k + 8]], 1), axis=1, bitorder="little")[:, 0] for k in range(0, 32, 8)]
    return np.ascontiguousarray(np.stack(rows, 1)).view("<u4").ravel()


class Writer:
    """Appends documents' ids to one file; holds one block and the index in memory."""

    def __init__(self, sink, bits: bool = False):
        self.sink, self.bits, self.pack = sink, bits, zstandard.ZstdCompressor(level=3)
        self.left, self.at = np.zeros(0, np.uint32), len(MAGIC)
        self.blocks: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.starts = [0]
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """ends: where each document's ids end in ids."""
        base = self.starts[-1]
        self.doc_ids += doc_ids
        self.starts += (ends + base).tolist()
        self.left = np.concatenate([self.left, ids])
        while len(self.left) >= BLOCK:
            self._block(self.left[:BLOCK])
            self.left = self.left[BLOCK:]

    def extend(self, doc_id: int | None, ids: np.ndarray, new: bool) -> None:
        """The next ids of the last document, or of a new one, which may be more than memory should hold at once."""
        if new:
            self.add([doc_id], ids, np.array([len(ids)]))
        else:
            self.add([], ids, np.zeros(0, np.int64))
            self.starts[-1] += len(ids)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
        footer = self.pack.compress(json.dumps({"block": BLOCK, "blocks": self.blocks, "doc_ids": self.doc_ids, "starts": self.starts}).encode())
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads one file's index, and any range of its ids by decompressing only the blocks that hold it."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - len(MAGIC) - 8)
        tail = source.read(len(MAGIC) + 8)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - len(MAGIC) - 8 - length)
        self.index = json.loads(self.unpack.decompress(source.read(length)))
        self.block = functools.lru_cache(maxsize=2)(self._block)

    def _block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index["blocks"][k]
        self.source.seek(at)
        return from_planes([self.unpack.decompress(self.source.read(s)) for s in sizes], n)

    def crc32(self, start: int, stop: int) -> int:
        """Of a range of ids as little-endian uint32, block by block."""
        crc = 0
        for k in range(start, stop, 16 * self.index["block"]):
            crc = zlib.crc32(self.ids(k, min(stop, k + 16 * self.index["block"])).astype("<u4").data, crc)
        return crc

    def ids(self, start: int, stop: int) -> np.ndarray:
        size = self.index["block"]
        parts = [self.block(k)[max(start - k * size, 0) : stop - k * size] for k in range(start // size, -(-stop // size))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size() + 1, bool)  # the ids that end a piece
    last[[i for token, i in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
    return tokenizer, last, Remembered()


class Remembered:
    """Words and their ids, in flat arrays. Beyond REMEMBERED words, the half that was met least often is forgotten."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids, self.n, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def forget(self) -> None:
        if len(self.words) > REMEMBERED:
            kept = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED // 2])
            first = np.cumsum(self.n) - self.n
            self.ids, self.words, self.n, self.met = self.ids[ragged(first[kept], self.n[kept])], self.words.take(pa.array(kept)), self.n[kept], self.met[kept] >> 1


def _library(tokenizer, last: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by the tokenizers library, and how many each has. Words of one piece are encoded CALL at a time, with a
    blank between, and told apart by the ids that end a piece."""
    plain = pc.and_(pc.match_substring_regex(words, ONE_PIECE), pc.invert(pc.match_substring(words, "\u0130"))).to_numpy(zero_copy_only=False)
    names, at = words.to_pylist(), np.flatnonzero(plain)
    calls, odd = [at[k : k + CALL] for k in range(0, len(at), CALL)], np.flatnonzero(~plain).tolist()
    spelt: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]  # number of the word, id
    for k in range(0, len(calls), 100):
        group = calls[k : k + 100]
        texts = [" ".join([names[i] for i in part.tolist()]) for part in group]
        for part, e in zip(group, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(last[ids])
            if len(ids) and ends[-1] == len(part) and last[ids[-1]]:
                spelt.append((part[ends - last[ids]], ids))
            else:
                odd += part.tolist()
    for k in range(0, len(odd), 20_000):
        some = odd[k : k + 20_000]
        each = [e.ids for e in tokenizer.encode_batch_fast([names[i] for i in some], add_special_tokens=False)]
        n = np.fromiter(map(len, each), np.int64, len(each))
        spelt.append((np.repeat(np.array(some, np.int64), n), np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(n.sum()))))
    which = np.concatenate([w for w, _ in spelt])
    return np.concatenate([i for _, i in spelt])[np.argsort(which, kind="stable")], np.bincount(which, minlength=len(words))


def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts between which the vocabulary cuts words anyway, lower-cased as it does, and the offsets of each word's."""
    latin = pc.and_(pc.match_substring_regex(words, "^[\\x00-\u00ff]*$"), pc.invert(pc.match_substring(words, "<|")))
    cut = pc.replace_substring_regex(words, f"({LETTER})({MARK})", r"\1 \2")
    cut = pc.replace_substring_regex(cut, f"({MARK})({LETTER})", r"\1 \2")
    return words_of(pc.if_else(latin, pc.utf8_lower(cut), pc.if_else(pc.match_substring(words, "<|"), words, cut)))


def encode_words(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by the tokenizers library, and where each text's begin.

    The vocabulary drops white space and no token crosses it, nor the border of letters and most marks, so the library encodes
    each distinct part of a word once, and workers remember those they meet most. It also lower-cases, so Latin words are
    lower-cased first.
    """
    tokenizer, last, known = _tokenizer(path)
    words, at = words_of(texts)
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parts, part_at = _parts(coded.dictionary)
    parts = parts.dictionary_encode()
    place = pc.index_in(parts.dictionary, value_set=known.words)
    new = parts.dictionary.filter(place.is_null())
    before = len(known.words)
    known.add(new, *_library(tokenizer, last, new))
    place = place.to_numpy(zero_copy_only=False).copy()
    place[np.isnan(place)] = before + np.arange(len(new))
    place = place.astype(np.int64)[parts.indices.to_numpy(zero_copy_only=False)]  # of each word's parts, what is remembered
    known.met += np.bincount(place, weights=np.repeat(np.bincount(which, minlength=len(part_at) - 1), np.diff(part_at)), minlength=len(known.met)).astype(np.int64)
    first = np.cumsum(known.n) - known.n
    spelt, size = known.ids[ragged(first[place], known.n[place])], np.concatenate([[0], np.cumsum(known.n[place])])
    begin, n = size[part_at[:-1]], np.diff(size[part_at])  # of each distinct word
    known.forget()
    ends = np.concatenate([[0], np.cumsum(n[which])])
    return spelt[ragged(begin[which], n[which])], ends[at]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end: int = END, bits: bool = False, roll: int = ROLL) -> DataFrame:
    """Writes files, in ascending doc_id; the rows (part, number, path, docs, tokens, before) of the files. Files are in order
    of part and number; before: the ids of a part's earlier files. folder: with its scheme."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        task, system, base = TaskContext.get(), *file_system(folder)
        part, number, before, writer, sink = task.partitionId(), 0, 0, None, None
        name = f"part-{part:06d}-{task.taskAttemptId()}-{{:06d}}.planes"

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.record_batch({"part": [part], "number": [number], "path": [f"{folder}/{name.format(number)}"], "docs": [len(writer.doc_ids)], "tokens": [writer.starts[-1]], "before": [before]})

        begun = True
        for batch, texts, more in pieces(batches, limit=BATCH):
            if writer is None:
                system.create_dir(base, recursive=True)
                writer = Writer(sink := system.open_output_stream(f"{base}/{name.format(number)}"), bits)
            ids, at = encode_words(vocabulary, texts)
            if more or not begun:
                writer.extend(batch.column("doc_id")[0].as_py(), ids if more else np.append(ids, np.uint32(end)), begun)
                begun = not more
            else:
                stops = at[1:] + np.arange(1, len(at))
                out = np.full(len(ids) + batch.num_rows, end, np.uint32)
                kept = np.ones(len(out), bool)
                kept[stops - 1] = False
                out[kept] = ids
                writer.add(batch.column("doc_id").to_pylist(), out, stops)
            if begun and (writer.at >= roll or len(writer.doc_ids) >= FILE_DOCS):
                yield closed()
                writer, number, before = None, number + 1, before + writer.starts[-1]
        if writer is not None:
            yield closed()

    return dealt.mapInArrow(run, "part long, number long, path string, docs long, tokens long, before long")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per document of the files that write_tokens tells of: doc_id, start (ids before it), n_tokens, ids_crc32.

    To the driver comes one total for each part, of which there are as many as shuffle partitions.
    """
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("tokens"), F.count("*")).collect())
    begin = itertools.accumulate((t[1] for t in totals), initial=0)
    starts = spark.createDataFrame([(t[0], b) for t, b in zip(totals, begin)], "part long, begin long")
    listed = files.join(F.broadcast(starts), "part").select("path", (F.col("begin") + F.col("before")).alias("first"))

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                system, place = file_system(path)
                with system.open_input_file(place) as source:
                    reader = Reader(source)
                    doc_ids, starts = reader.index["doc_ids"], reader.index["starts"]
                    for k in range(0, len(doc_ids), 2000):
                        some = doc_ids[k : k + 2000]
                        ends = starts[k : k + len(some) + 1]
                        crc = [reader.crc32(a, b) for a, b in itertools.pairwise(ends)]
                        yield pa.record_batch({"doc_id": pa.array(some, pa.int64()), "start": pa.array([first + a for a in ends[:-1]], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in itertools.pairwise(ends)], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return listed.repartition(max(1, sum(t[2] for t in totals))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read_tokens(spark, staged(spark, write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary_path("word_bpe_49k.json")), "token-files"))
