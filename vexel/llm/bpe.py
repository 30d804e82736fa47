"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' commonest words, counted over all documents, are compiled with their ids into an automaton that shares
suffixes. Spark ships its file to each executor, whose workers memory-map it. Words that it lacks are merged exactly.

A text is cut at blanks first. No token crosses such a cut unless it is inside a run of white space, so equal pieces
are encoded once a batch. Texts with a cut inside white space, or with the text of a special token, are taken whole.

Defined results: null text counts as empty, and has no ids; ids are those of the tokenizers library without added
special tokens; repeated rows are encoded each; an empty table gives an empty result; other columns are ignored; very
long texts are encoded in pieces of a few MB, cut at such blanks, and only their ids are held together.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import itertools
import json
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import pieces as pieces_of
from .common import staged, table, text_or_empty
from .transducer import Lexicon, Table, compile_words, load, pieces, save

#: Words compiled into the lexicon, at most, how often each occurs at least, and the code points of the longest: the driver
#: holds at most WORDS * LONGEST of them. Longer words are merged like unseen ones.
WORDS, LEAST, LONGEST = 60_000, 2, 64
#: White space, fixed by Unicode.
SPACE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same white space for Arrow's RE2: a blank between white space, or between white space and the end.
_RE2 = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where a long text is cut: before a blank between two printable ASCII characters, where a piece begins anyway.
BETWEEN = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")
ODD = rf"{_RE2} (?:{_RE2}|\z)"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Merge and byte tables of a byte-level BPE vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    raw, back = [b""] * size, {s: b for b, s in enumerate(symbols)}
    for token, i in vocab.items():
        raw[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        raw[i] = token.encode()
    return {"special": special, "arrays": {
        "pair_key": keys, "pair_slot": Table.build(keys).slots, "merged": np.array([vocab[a + b] for a, b in pairs], np.int32),
        "byte_id": np.array([vocab[s] for s in symbols], np.int32), "token": np.frombuffer(b"".join(raw), np.uint8), "token_at": np.cumsum([0, *map(len, raw)]),
    }}


def frequent_words(docs: DataFrame, most: int, least: int = LEAST) -> list[str]:
    """The commonest blank-separated words of all documents. A histogram of their counts says from which count on there
    are at most `most` of them; only those come to the driver."""
    words = docs.select(F.explode(F.split(text_or_empty(docs), " ")).alias("word")).where(F.length("word").between(1, LONGEST))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    counted = staged(docs.sparkSession, counted, "words")
    total, cut = 0, None
    for r in sorted(counted.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        cut = r["step"]
    return [] if cut is None else [r["word"] for r in counted.where(F.col("step") >= cut).select("word").collect()]


class Codec:
    """Encodes and decodes batches of texts; what it needs lies in one memory-mapped file."""

    def __init__(self, path: str, special: dict[str, int]):
        self.a, self.special = load(path), special
        self.lexicon = Lexicon(self.a)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _pretokens(self, chunk: str) -> list[str]:
        if self.split is None or not self.split.search(chunk):
            return PRETOKEN.findall(chunk)
        return [t for part in self.split.split(chunk) for t in ([part] if part in self.special else PRETOKEN.findall(part))]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split = [PRETOKEN.findall(c) for c in chunks] if self.split is None else [self._pretokens(c) for c in chunks]
        many = np.fromiter(map(len, split), np.int64, len(split))
        words = pa.array(list(itertools.chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        text = words.dictionary
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] else np.zeros(1, np.uint8)
        flat, first, n = self.lexicon.encode(data, at[:-1], np.diff(at))
        for token, i in self.special.items():
            for k in np.flatnonzero(pc.equal(text, token).to_numpy(zero_copy_only=False)) if len(text) else ():
                first[k], n[k], flat = len(flat), 1, np.append(flat, np.int32(i))
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n[which])])
        ids = pieces(flat, first, n, which)
        stop = np.cumsum(many)
        return ids, ends[stop - many], ends[stop] - ends[stop - many]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, uint32, and where each text's begin (one more than texts)."""
        odd = pc.match_substring_regex(texts, ODD)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        lists = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
        at = np.asarray(lists.offsets.to_numpy(), np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1
        code[at[:-1]] -= 1  # the first piece of a text has no blank before it
        names, used = coded.dictionary.to_pylist(), np.zeros(2 * len(coded.dictionary), bool)
        used[code] = True
        chunks = [" " + names[c >> 1] if c & 1 else names[c >> 1] for c in np.flatnonzero(used).tolist()]
        code = (np.cumsum(used) - 1)[code]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        code[at[whole]] = len(chunks) + np.arange(len(whole))
        flat, first, n = self._chunks(chunks + texts.take(pa.array(whole)).to_pylist())
        ends = np.concatenate([[0], np.cumsum(n[code])])
        return pieces(flat, first, n, code).astype("<u4"), ends[at]

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids in UTF-8; bytes that aren't UTF-8 become replacement characters."""
        first = self.a["token_at"][ids]
        raw = pieces(self.a["token"], self.a["token_at"][:-1], np.diff(self.a["token_at"]), ids.astype(np.int64)).tobytes() if len(first) else b""
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=2)
def _codec(name: str, special: tuple) -> Codec:
    return Codec(SparkFiles.get(name), dict(special))


@functools.cache
def _served() -> str:
    """The driver's folder of lexicons. Spark serves them to executors, also to those that join later, so they stay until it ends."""
    folder = tempfile.mkdtemp(prefix="vexel-lexicons-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Encoder:
    """A vocabulary with a lexicon of a corpus' frequent words, ready on all executors."""

    def __init__(self, spark: SparkSession, vocabulary: str, docs: DataFrame | None = None, words: int = WORDS):
        spec = read_vocabulary(vocabulary)
        found = {w.encode() for word in (frequent_words(docs, words) if docs is not None else []) for t in (word, " " + word) for w in PRETOKEN.findall(t)}
        listed = sorted(found - {t.encode() for t in spec["special"]})
        empty = spec["arrays"] | compile_words([]) | {"ids": np.zeros(0, np.int32), "ids_at": np.zeros(1, np.int64)}
        at = np.cumsum([0, *map(len, listed)])
        flat, first, n = Lexicon(empty).encode(np.frombuffer(b"".join(listed) or b"\0", np.uint8), at[:-1], np.diff(at))
        arrays = spec["arrays"] | compile_words(listed) | {"ids": pieces(flat, first, n, np.arange(len(listed))), "ids_at": np.concatenate([[0], np.cumsum(n)]).astype(np.int64)}
        self.name, self.special = f"lexicon-{uuid.uuid4().hex}.bin", tuple(spec["special"].items())
        path = os.path.join(_served(), self.name)
        save(path, arrays)
        spark.sparkContext.addFile(path)

    def encode(self, docs: DataFrame, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
        """One row per document: doc_id, n_tokens and the columns asked for: ids, decoded, ids_sha256, decoded_sha256."""
        name, special = self.name, self.special
        kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

        def run(batches):
            codec, held = _codec(name, special), []  # ids of a long text's pieces so far
            for batch, texts, more in pieces_of(batches, cut=BETWEEN):
                ids, at = codec.encode(texts)
                if more or held:
                    held.append(ids)
                    if more:
                        continue
                    ids, held = np.concatenate(held), []
                    at = np.array([0, len(ids)])
                out = {"doc_id": batch.column("doc_id"), "n_tokens": np.diff(at)}
                each = [ids[a:b] for a, b in itertools.pairwise(at.tolist())]
                if "ids" in columns:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                if "ids_sha256" in columns:
                    out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in each]
                if {"decoded", "decoded_sha256"} & {*columns}:
                    back = [codec.decode(x) for x in each]
                    out |= {"decoded": [x.decode() for x in back]} if "decoded" in columns else {}
                    out |= {"decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]} if "decoded_sha256" in columns else {}
                yield pa.record_batch({c: pa.array(out[c], pa.string()) if isinstance(out[c], list) else out[c] for c in ("doc_id", "n_tokens", *columns)})

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            run, "doc_id long, n_tokens long" + "".join(f", {c} {kinds[c]}" for c in columns))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Encoder(spark, vocabulary_path("byte_bpe_50k.json"), docs).encode(docs, ("ids_sha256", "decoded_sha256"))
