"""SimHash near-dedup with pivot distance tables.

Fingerprints within LINK bits are linked; documents of linked fingerprints form components. Only distinct fingerprints
are compared. They are cut into blocks so that any two linked ones agree in some blocks; each such agreement is a bucket.
Inside a bucket, the distances of every fingerprint to the pivots are computed once, and by the triangle inequality a
pair whose distances to some pivot differ by more than LINK is discarded without being compared; what survives is
verified. Buckets are searched breadth first and yield spanning trees, never all pairs. Buckets that are large all the
same are searched by pairs of their parts, each pair in a task of its own. The trees' edges are then
contracted to components by alternating stars, on the cluster, with each round written to the shared folder.

How many blocks there are follows from the number of distinct fingerprints, so that buckets stay small; any choice
loses no link.

Defined results: null text and text without words have fingerprint zero, linked like any other; a null doc_id is no
component's name unless all of its component's are null; rows that repeat a doc_id stand for themselves; an empty table
gives an empty result; other columns are ignored; a very long text is hashed in pieces of a few MB, whose bits add up.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import joined_words, pieces, words_of
from .common import join_facts, staged, table, text_or_empty

#: Words of a shingle, differing bits at which fingerprints link, pivots, and fingerprints a bucket should hold at most.
SHINGLE, LINK, PIVOTS, BUCKET = 4, 4, 32, 2048
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(words: pa.Array, at: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles, one text after the other, and how many each text has. at: where each text's words
    begin and end."""
    n = np.diff(at)
    data, first, last = joined_words(words, at)
    data = data.translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
    many = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.repeat(at[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    stop = begin + np.repeat(np.minimum(n, shingle), many) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(first[begin].tolist(), last[stop].tolist())), np.uint64, len(begin)), many


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash (uint64) of each text's word shingles."""
    hashes, many = shingle_hashes(*words_of(texts), shingle)
    out = np.zeros(len(many), np.uint64)
    ends = np.concatenate([[0], np.cumsum(many)])
    for a, b in _runs(ends, 1 << 16):
        rows = hashes[ends[a] : ends[b]]
        bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((b - a, 64), np.int64)
        full = np.flatnonzero(many[a:b])
        if len(full):
            sums[full] = np.add.reduceat(bits, ends[a:b][full] - ends[a], axis=0, dtype=np.int32)
        out[a:b] = np.packbits(sums * 2 > many[a:b, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _runs(ends: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of texts of about `limit` shingles; a longer text is a range of its own."""
    out, a = [], 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text), fp (the fingerprint as a signed long)."""

    def run(batches):
        held = None  # of a long text: last words, sums of bits and number of shingles so far
        for batch, texts, more in pieces(batches):
            if more or held is not None:
                held = _add_piece(texts, held, shingle, more)
                if more:
                    continue
                found, held = held, None
            else:
                found = fingerprints(texts, shingle)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": found.view(np.int64)})

    text = text_or_empty(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _add_piece(texts: pa.Array, held, shingle: int, more: bool):
    """What is held after the next piece of a long text; after its last one, the fingerprint."""
    words, sums, many = held or (pa.array([], pa.large_string()), np.zeros(64, np.int64), 0)
    words = pa.concat_arrays([words, words_of(texts)[0].cast(pa.large_string())])
    if len(words) >= shingle or (not more and not many):  # a short rest has been hashed already
        hashes, n = shingle_hashes(words, np.array([0, len(words)]), shingle)
        many += int(n[0])
        for k in range(0, len(hashes), 1 << 16):
            sums = sums + np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if more:
        return words[max(0, len(words) - shingle + 1) :], sums, many
    return np.packbits(sums * 2 > many, bitorder="little").view(np.uint64)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: zero, and fixed pseudo-random ones."""
    return np.concatenate([[0], np.random.default_rng(7).integers(0, 2**64, count - 1, np.uint64, endpoint=False)]).astype(np.uint64)


def block_masks(distinct: int, link: int = LINK, bucket: int = BUCKET) -> list[int]:
    """Masks such that any two values at most `link` bits apart agree under one: all choices of b - link of b blocks,
    with b least for random values to share a bucket with at most `bucket` others."""
    for blocks in range(link + 1, 65):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
        masks = [sum(c) for c in itertools.combinations(parts, blocks - link)]
        if distinct >> min(m.bit_count() for m in masks) <= bucket or len(masks) > 400:
            return masks
    raise AssertionError


def _search(values: np.ndarray, table: np.ndarray, link: int) -> list[tuple[int, int]]:
    """Spanning trees of one bucket's links. table: distances to the pivots; rows ascend by the first."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(values))
    while len(left) > 1:
        tree, left = [int(left[0])], left[1:]
        for x in tree:
            low, high = np.searchsorted(table[left, 0], [table[x, 0] - link, table[x, 0] + link + 1])
            near = left[low:high]
            if not len(near):
                continue
            near = near[np.abs(table[near] - table[x]).max(1) <= link]
            near = near[np.bitwise_count(values[near] ^ values[x]) <= link]
            if len(near):
                tree += near.tolist()
                edges += [(x, y) for y in near.tolist()]
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def links(spark: SparkSession, distinct: DataFrame, number: int, link: int = LINK, bucket: int = BUCKET) -> DataFrame:
    """distinct (fp): edges (a, b) that connect exactly the fingerprints that links connect."""
    masks = block_masks(number, link, bucket)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("block")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("key")).select("fp", F.xxhash64("key").alias("bucket"))
    sizes = staged(spark, rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = join_facts(rows, sizes, ["bucket"], "n", max(1, number * len(masks)))
    # a bucket larger than BUCKET is searched by pairs of its parts, so no task holds more than two parts of it
    parts = shared.withColumn("parts", F.ceil(F.col("n") / bucket).cast("int")).withColumn("mine", F.pmod(F.xxhash64("bucket", "fp"), F.col("parts")).cast("int"))
    dealt = parts.select("fp", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), F.bit_count("fp").cast("int").alias("ones"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "ones")
    refs = pivots()

    def run(batches):
        rest_b, rest_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                bucket, value, cut = rest_b, rest_v, len(rest_b)
            else:
                bucket = np.concatenate([rest_b, batch.column("bucket").to_numpy()])
                value = np.concatenate([rest_v, batch.column("fp").to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(-(bucket != bucket[-1]).astype(np.int8), 0)) if len(bucket) else 0
            rest_b, rest_v = bucket[cut:], value[cut:]
            bucket, value = bucket[:cut], value[:cut]
            if not cut:
                continue
            table = np.bitwise_count(value[:, None] ^ refs).astype(np.int8)
            a, b = _near(bucket, value, table, link)
            yield pa.record_batch({"a": value[a].view(np.int64), "b": value[b].view(np.int64)})

    return dealt.mapInArrow(run, "a long, b long").distinct()


#: Buckets up to this size are compared side by side; larger ones are searched one at a time.
SMALL = 96


def _near(bucket: np.ndarray, value: np.ndarray, table: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    sizes = np.diff(np.append(starts, len(bucket)))
    edges = [(s + x, s + y) for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]) for x, y in _search(value[s : s + n], table[s : s + n], link)]
    i = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    end = np.repeat(starts + sizes, sizes)[i]
    left, right, step = [np.array([x for x, _ in edges], np.int64)], [np.array([y for _, y in edges], np.int64)], 1
    while len(i):
        on = i + step < end
        i, end = i[on], end[on]
        close = table[i + step, 0] - table[i, 0] <= link
        i, end = i[close], end[close]  # rows ascend by the first pivot: what is too far now stays too far
        j = i[np.abs(table[i + step] - table[i]).max(1) <= link] if len(i) else i
        j = j[np.bitwise_count(value[j + step] ^ value[j]) <= link]
        left.append(j)
        right.append(j + step)
        step += 1
    return np.concatenate(left), np.concatenate(right)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b): the rows (node, root) of all nodes that are no root; root is the least node of its component.

    Alternating stars: in a large star every larger neighbour of a node moves to the node's least neighbour, in a small
    star every smaller one does. Edges never grow in number, and the rounds are logarithmic in the longest path.
    """
    now = staged(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    total = now.count()
    while total:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = _star(spark, both, 2 * total, F.col("v") > F.col("u"), "large")
        after = _star(spark, after.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 2 * total, F.lit(True), "small")
        changed = after.exceptAll(now).limit(1).count() or now.count() != after.count()
        now = after
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _star(spark: SparkSession, rows: DataFrame, total: int, moves: Column, name: str) -> DataFrame:
    """rows (u, v): each v that moves gets an edge to the least of u and u's neighbours."""
    rows = staged(spark, rows, f"{name}-in")
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = join_facts(rows, staged(spark, least, f"{name}-least"), ["u"], "n", total)
    moved = joined.where(moves).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    own = least.where("u <> m").select("u", F.col("m").alias("v")) if name == "small" else moved.limit(0)
    return staged(spark, moved.unionByName(own).distinct(), name)


def judged(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, link: int = LINK) -> DataFrame:
    """One row per document: doc_id, th (a hash of its text), fp (long), root (a fingerprint that names its component) and
    component_id (the smallest doc_id that links reach, itself included)."""
    rows = staged(spark, with_fingerprint(docs, shingle), "fingerprints")
    distinct = staged(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    number, total = distinct.agg(F.count("*"), F.sum("n")).first()
    roots = components(spark, links(spark, distinct.select("fp"), number, link))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(spark, named, "roots")
    sizes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    facts = staged(spark, join_facts(named.select("root", "fp", "n"), staged(spark, sizes, "components"), ["root"], "members", number or 1).select("fp", "n", "root", "component_id"), "facts")
    return join_facts(rows, facts, ["fp"], "n", total or 1).select("doc_id", "th", "fp", "root", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, link: int = LINK) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id."""
    return judged(spark, docs, shingle, link).select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, link: int = LINK) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component one row of the smallest doc_id. Rows are told apart by
    doc_id and text, so rows that share a doc_id but aren't near copies all stay; of rows that repeat both, one does. Rows
    without doc_id stay only where their component has no other."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = judged(spark, docs, shingle, link).groupBy("root").agg(F.min(order).alias("best"))
    stay = staged(spark, best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.th").alias("keep_th")), "keepers")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(text_or_empty(docs)).alias("t"))
    kept = whole.join(stay, F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("t") == F.col("keep_th")), "left_semi")
    return kept.dropDuplicates(["i", "t"]).select("doc.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
