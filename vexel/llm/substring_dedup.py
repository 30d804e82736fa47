"""Substring dedup: recurring passages confirmed, compiled into sharded Aho-Corasick automata, and located everywhere.

A window is WINDOW consecutive words. A word goes if some window over it also starts earlier, in a smaller doc_id or
earlier in the same document.

1. Every window has an anchor: the least of its word k-grams by hash. Anchors of the whole corpus are counted; those
   that recur enter a sharded hash index. A window that recurs has a recurring anchor.
2. Documents probe the index. Consecutive windows with the same recurring anchor make a candidate segment. Equal
   segments are collapsed, with the first place where each occurs, before any task has to hold them.
3. Segments are dealt by anchor, so all windows of equal words meet in one shard. A shard confirms the windows whose
   hash occurs twice or more, joins those that always follow each other to passages, and compiles the passages into
   automata, with each word one character. Where passages are, and where first, only the automaton says: the shard's
   segments are streamed through it, and the first of the places where it finds a passage is that passage's place.
4. What the automata located goes back to the places of each segment; a document drops the words of all windows that
   aren't at their first place.

Anchors in very many places (HOT or more) have their windows dealt by the window's own hash instead, so that no shard
gathers all the different neighbourhoods of one common line. So a shard holds fewer than HOT segments, each of at most
WINDOW - GRAM + 1 windows.

Defined results: null text has no words; a null doc_id is smaller than any other; rows that repeat a doc_id count as
one document, so equal starts in them are not earlier than each other; an empty table gives an empty result; other
columns are ignored; very long texts are taken in pieces of a few MB, with the words of a window carried over, so only
the text itself is ever whole in memory.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import joined_words, pieces, ragged, words_of
from .common import NO_ID, join_facts, staged, table
from .hash_index import HashIndex

#: Words of a window and of an anchor; places from which an anchor is hot; windows of an automaton, about.
WINDOW, GRAM, HOT, AUTOMATON = 20, 8, 1000, 20_000
#: Bytes of text that are taken apart at once.
BATCH = 2 << 20


def word_batches(batches, carried: int = 0):
    """Rows, their words and text offsets, the number of each text's first word, and whether the text goes on. A long text
    comes in pieces, each but the first led by the last `carried` words of the one before."""
    carry, base = None, 0
    for part, texts, more in pieces(batches, limit=BATCH):
        words, at = words_of(texts)
        if carry is not None:
            words, at = pa.concat_arrays([carry, words]), at + len(carry) * (np.arange(len(at)) > 0)
        yield part, words, at, np.full(part.num_rows, base), more
        last = max(0, len(words) - carried)
        carry, base = (words[last:], base + last) if more else (None, 0)


def anchors(words: pa.Array, at: np.ndarray, window: int, gram: int):
    """For every window in order: its start (a word's place) and its anchor's place; and the hash of the gram at each
    place."""
    coded = words.dictionary_encode()
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = one[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    n = max(len(h) - gram + 1, 0)
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    span, width = window - gram + 1, 1
    low = np.uint64(2**24 - 1)  # a place, in the low bits: batches have fewer words, and of equal grams the leftmost is the least
    least = g & ~low | np.arange(n, dtype=np.uint64)
    while width < span:  # the least of 1, 2, 4, ... grams
        step = min(width, span - width)
        least = np.minimum(least[step:], least[: max(len(least) - step, 0)])
        width += step
    place = (least & low).astype(np.int64)
    count = np.maximum(np.diff(at) - window + 1, 0)
    start = ragged(at[:-1], count)
    return start, place[start] if len(start) else start, g


def _second(anchor: np.ndarray) -> np.ndarray:
    """The low word of an anchor's key: it follows from the anchor."""
    return (anchor ^ (anchor >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _runs(place: np.ndarray) -> np.ndarray:
    """Where windows with a new anchor place begin."""
    return np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else np.zeros(0, np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """Document, its place in the order, and a hash that tells rows of one doc_id apart."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def recurring_anchors(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> HashIndex:
    """Index of the anchors in two or more places, with the number of places."""

    def run(batches):
        for _, words, at, _, _ in word_batches(batches, window - 1):
            _, place, g = anchors(words, at, window, gram)
            found, n = np.unique(g[place[_runs(place)]], return_counts=True)
            yield pa.record_batch({"hi": found.view(np.int64), "lo": _second(found).view(np.int64), "n": n.astype(np.int64)})

    counted = docs.select("text").mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    repeated = staged(spark, counted.where("n >= 2"), "anchors")
    return HashIndex.build(spark, repeated, repeated.count(), {"n": "uint16"})


def segments(docs: DataFrame, index: HashIndex, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Every place of every candidate segment: d, th, start (a word's number), shard (what it is dealt by), hi and lo
    (its words' hash), words."""

    def run(batches):
        for batch, words, at, base, _ in word_batches(batches, window - 1):
            start, place, g = anchors(words, at, window, gram)
            cut = _runs(place)
            anchor = g[place[cut]]
            found, value = index.find(anchor, _second(anchor))
            many = np.diff(np.append(cut, len(start)))
            first, many, anchor, often = start[cut][found], many[found], anchor[found], value["n"][found] >= hot
            # the windows of a hot anchor are segments of their own
            each = np.where(often, many, 1)
            size = np.repeat(np.where(often, 1, many), each)
            begin = np.repeat(first, each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
            anchor, often = np.repeat(anchor, each), np.repeat(often, each)
            data, left, right = joined_words(words, at)
            text = [data[a:b] for a, b in zip(left[begin].tolist(), right[begin + size + window - 2].tolist())]
            pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, text)), np.int64).reshape(-1, 2)
            owner = np.searchsorted(at, begin, "right") - 1
            yield pa.record_batch({
                "d": batch.column("d").to_numpy()[owner], "th": batch.column("th").to_numpy()[owner], "start": begin - at[owner] + base[owner],
                "shard": np.where(often, pair[:, 0], anchor.view(np.int64)), "hi": pair[:, 0], "lo": pair[:, 1], "words": pa.array(text, pa.binary()).cast(pa.string()),
            })

    return _rows(docs).select("d", "th", "text").mapInArrow(run, "d long, th long, start long, shard long, hi long, lo long, words string")


def _locate(rows: pa.Table, window: int) -> pa.RecordBatch:
    """rows (hi, lo, n, d, start, words) of whole shard keys: hi, lo, n and the recurring passages' offsets, sizes (in words)
    and first places (docs, starts), for segments where some place has a passage that isn't at its first place."""
    import ahocorasick

    words, at = words_of(rows["words"].combine_chunks().cast(pa.large_string()))
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    code += 0x800 * (code >= 0xD800)  # no surrogates
    many = np.diff(at) - window + 1
    n, d, first = (rows[c].to_numpy() for c in ("n", "d", "start"))

    # windows that occur twice or more, by a rolling hash of their words
    mixed = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(max(0, len(code) - window + 1), np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x94D049BB133111EB) + mixed[j : j + len(rolled)]
    place, times = ragged(at[:-1], many), np.repeat(n, many)
    _, index, of = np.unique(rolled[place], return_index=True, return_inverse=True)
    count = np.bincount(of, weights=times, minlength=len(index)).astype(np.int64)

    # windows that always follow each other make one passage
    inner = np.ones(len(place), bool)
    inner[np.cumsum(many) - 1] = False  # those with a next window in their segment
    here = np.flatnonzero(inner)
    pair, which = np.unique(of[here] * len(index) + of[here + 1], return_inverse=True)
    one, two = pair // max(1, len(index)), pair % max(1, len(index))
    bound = (np.bincount(which, weights=times[here], minlength=len(pair)) == count[one]) & (count[one] == count[two])
    led = np.zeros(len(index), bool)
    led[two[bound]] = True
    goes_on = np.zeros(len(place), bool)
    goes_on[here] = bound[which]
    last = np.flatnonzero(~goes_on)
    head = index[(count > 1) & ~led]
    length = last[np.searchsorted(last, head)] - head + 1
    head = place[head]

    # passages are the automaton's phrases; segments are one text, with a character that is no word between them
    segment = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spaced = np.zeros(len(code) + len(at), "<u4")
    spaced[np.arange(len(code)) + segment] = code
    text = spaced.tobytes().decode("utf-32-le")
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for key, (a, b) in enumerate(zip((head + segment[head]).tolist(), (head + segment[head] + length + window - 1).tolist())):
        machine.add_word(text[a:b], key)
    hits = np.zeros(0, [("end", np.int64), ("key", np.int64)])
    if len(head):
        machine.make_automaton()
        hits = np.fromiter(machine.iter(text), hits.dtype)
    key, start = hits["key"], hits["end"] - window + 2 - length[hits["key"]]
    owner = np.searchsorted(at[1:] + np.arange(len(at) - 1), start, "right")
    offset = start - at[owner] - owner

    # a passage's first place, of all where it was found
    doc, word = d[owner], first[owner] + offset
    order = np.lexsort((word, doc, key))
    lead = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
    best = np.zeros(len(head), np.int64)
    best[key[lead]] = lead
    best = best[key]
    late = (doc[best] != doc) | (word[best] != word)
    kept = np.flatnonzero(late | (n[owner] > 1))  # of a segment with one place, only what goes there
    kept = kept[np.argsort(owner[kept], kind="stable")]
    size = np.bincount(owner[kept], minlength=len(n))
    told = np.flatnonzero(size)
    ends = pa.array(np.concatenate([[0], np.cumsum(size[told])]), pa.int32())
    lists = {"offsets": offset[kept], "sizes": length[key[kept]] + window - 1, "docs": doc[best][kept], "starts": word[best][kept]}
    return pa.record_batch({c: rows[c].to_numpy()[told] for c in ("hi", "lo", "n")} | {c: pa.ListArray.from_arrays(ends, pa.array(v)) for c, v in lists.items()})


def located(spark: SparkSession, places: DataFrame, window: int = WINDOW, automaton: int = AUTOMATON) -> DataFrame:
    """One row per distinct segment with recurring passages that go somewhere: hi, lo, n (places), and of each such passage
    the offset, the number of words and the first place: offsets, sizes, docs, starts."""
    distinct = places.groupBy("shard", "hi", "lo").agg(F.min(F.struct("d", "start")).alias("at"), F.count("*").alias("n"), F.first("words").alias("words"))
    dealt = distinct.select("shard", "hi", "lo", "n", "at.d", "at.start", "words").repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        held, windows = [], 0  # whole shard keys of about one automaton
        for batch in batches:
            many = pc.subtract(pc.count_substring(batch.column("words"), " "), window - 2).to_numpy()
            shard, total, begin = batch.column("shard").to_numpy(), np.cumsum(many), 0
            ends = np.flatnonzero(np.diff(shard)) + 1
            if held and batch.num_rows and held[-1].column("shard")[-1].as_py() != shard[0]:
                ends = np.concatenate([[0], ends])
            for end in ends.tolist():
                so_far = total[end - 1] - (total[begin - 1] if begin else 0) if end > begin else 0
                if windows + so_far >= automaton:
                    yield _locate(pa.Table.from_batches([*held, batch.slice(begin, end - begin)]), window)
                    held, windows, begin = [], 0, end
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                windows += int(many[begin:].sum())
        if held:
            yield _locate(pa.Table.from_batches(held), window)

    return staged(spark, dealt.mapInArrow(run, "hi long, lo long, n long, offsets array<long>, sizes array<long>, docs array<long>, starts array<long>"), "located")


def drop_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and text (the kept words) or kept_sha256 as asked for."""
    index = recurring_anchors(spark, docs, window, gram)
    places = staged(spark, segments(docs, index, window, gram), "segments")
    found = located(spark, places, window)
    narrow = places.select("d", "th", "start", "hi", "lo")
    joined = join_facts(narrow, found, ["hi", "lo"], "n", max(1, places.count()))
    late = F.filter(F.arrays_zip("offsets", "sizes", "docs", "starts"), lambda x: (x["docs"] != F.col("d")) | (x["starts"] != F.col("start") + x["offsets"]))
    marks = joined.select("d", "th", F.transform(late, lambda x: F.struct((F.col("start") + x["offsets"]).alias("start"), x["sizes"].alias("size"))).alias("gone")).where(F.size("gone") > 0)
    marks = marks.groupBy("d", "th").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    both = _rows(docs).join(marks.hint("merge"), ["d", "th"], "left").select("doc_id", "text", "gone")

    def run(batches):
        held: list[tuple[int, int, bytes]] = []  # n_words, n_removed and kept words of a long text's pieces so far
        for batch, words, at, base, more in word_batches(batches):
            gone = batch.column("gone")
            rows = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            many = np.array([len(gone[int(i)]) for i in rows], np.int64)
            low, high = np.repeat(at[rows], many), np.repeat(at[rows + 1], many)
            flat = gone.drop_null().flatten()
            start, size = flat.field("start").to_numpy() - np.repeat(base[rows], many) + low, flat.field("size").to_numpy()
            edge = np.bincount(np.clip(start, low, high), minlength=len(words) + 1) - np.bincount(np.clip(start + size, low, high), minlength=len(words) + 1)
            kept = np.cumsum(edge)[: len(words)] == 0
            before = np.concatenate([[0], np.cumsum(kept)])
            data, first, last = joined_words(words.filter(pa.array(kept, pa.bool_())), before[at])
            text = [data[first[a] : last[b - 1]] if b > a else b"" for a, b in itertools.pairwise(before[at].tolist())]
            n_words, n_removed = np.diff(at), np.diff(at) - np.diff(before[at])
            if more or held:
                held.append((int(n_words[0]), int(n_removed[0]), text[0]))
                if more:
                    continue
                n_words, n_removed, text = np.array([sum(h[0] for h in held)]), np.array([sum(h[1] for h in held)]), [b" ".join(h[2] for h in held if h[0] > h[1])]
                held = []
            out = {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed}
            made = {"text": lambda: [t.decode() for t in text], "kept_sha256": lambda: [hashlib.sha256(t).hexdigest() for t in text]}
            yield pa.record_batch(out | {c: pa.array(made[c](), pa.string()) for c in columns})

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long" + "".join(f", {c} string" for c in columns))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark, table(spark, sf_dir, "documents"), columns=("kept_sha256",))


ORACLE = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS key FROM s),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) > 1 AS late FROM k),
p AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM r WHERE late),
g AS (SELECT doc_id, list(i) AS gone FROM p GROUP BY doc_id),
j AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN p ON e.doc_id = p.doc_id AND e.i = p.i WHERE p.i IS NULL GROUP BY e.doc_id)
SELECT j.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM j LEFT JOIN t USING (doc_id)"""
}
