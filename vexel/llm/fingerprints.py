"""Document fingerprints by Order MinHash; native DataFrame operations only.

A text's k-mers are its runs of GRAM words, each with its occurrence number, so that repeats count. Hashes put them on a
circle, which is cut into BINS arcs. From the beginning of each arc on, the TUPLE least k-mers, that is the next ones on
the circle, are selected, put in their order in the text, and hashed to one element of the signature; so every element
tells of order, also in short texts, whose arcs are mostly empty. Two texts' likeness is the share of elements that are
equal: it falls when words change and also when they move, as edit distance does. A text shorter than a k-mer is one
k-mer, and a text of one k-mer has that alone in all elements.

Neighbours in the order of doc_id are found without one task seeing all rows: quantiles of doc_id cut the order into
buckets, and the first row of each bucket is also put, as a marker, behind the last row of the bucket before it.

Defined results: null text counts as empty, whose signature is empty; two empty signatures have likeness 1, an empty and
another 0; a null doc_id is smaller than any other; rows of equal doc_id are in order of a hash of their text; the next
document of a single one is itself; an empty table gives an empty result; other columns are ignored. Rows of equal doc_id
share a bucket. A very long text is signed in one task, in memory of about ten times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, table, text_or_empty

#: Words of a k-mer, k-mers of an element, and bits of an arc's number.
GRAM, TUPLE, BIN_BITS = 5, 2, 6
BINS = 1 << BIN_BITS
#: Documents of a bucket (about), and buckets at most: beyond BUCKET * MOST_BUCKETS rows buckets grow, and their sort spills.
BUCKET, MOST_BUCKETS = 200, 1 << 16
#: Powers of two that a binary search in an array adds up; arrays have less than 2^31 entries.
STEPS = "filter(array(" + ",".join(str(1 << k) for k in range(30, -1, -1)) + "), step -> step <= size({}))"
BLANK = "' \\t\\n\\u000b\\u000c\\r'"


def with_signature(df: DataFrame, text: str, name: str, gram: int = GRAM) -> DataFrame:
    """df and a column `name`: the signature of column `text`, an array of BINS ints, or none for a text without words."""
    cols = df.columns
    run = ", ".join(f"get(_w, i + {j})" for j in range(gram))
    bin_of = f"(CAST(shiftright({{}}, {64 - BIN_BITS}) AS INT) + {BINS // 2})"
    df = df.withColumn("_w", F.expr(f"transform(filter(split(btrim({text}, {BLANK}), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != ''), w -> xxhash64(w))"))
    df = df.withColumn("_g", F.expr(f"CASE WHEN size(_w) >= {gram} THEN transform(sequence(0, size(_w) - {gram}), i -> xxhash64({run})) WHEN size(_w) > 0 THEN array(xxhash64(_w)) ELSE array() END"))
    df = df.withColumn("_s", F.expr("sort_array(transform(_g, (h, i) -> struct(h AS h, i AS i)))"))
    # of equal k-mers, all but the first get their occurrence number, which is their distance from the first
    less = "aggregate(_steps, 0, (n, step) -> IF(n + step <= size(_s) AND get(_s, n + step - 1).h < x.h, n + step, n))"
    numbered = f"sort_array(transform(_s, (x, i) -> IF(get(_s, i - 1).h <=> x.h, struct(xxhash64(x.h, i - {less}) AS h, x.i AS i), x)))"
    df = df.withColumn("_steps", F.expr(STEPS.format("_s"))).withColumn("_e", F.expr(f"IF(size(array_distinct(_g)) < size(_g), {numbered}, _s)"))
    # the TUPLE first k-mers of each arc are all that can be among the next ones from some arc's beginning
    df = df.withColumn("_l", F.expr(f"filter(_e, (x, i) -> NOT ({bin_of.format(f'get(_e, i - {TUPLE}).h')} <=> {bin_of.format('x.h')}))"))
    df = df.withColumn("_b", F.expr(f"transform(_l, x -> {bin_of.format('x.h')})"))
    after = "get(_l, (i + 1) % size(_l))"
    pair = f"CASE WHEN size(_l) = 1 THEN xxhash64(x.h) WHEN x.i < {after}.i THEN xxhash64(x.h, {after}.h) ELSE xxhash64({after}.h, x.h) END"
    # a k-mer that is the first of its arc stands for that arc and the empty ones before; the last arcs go round to the first
    df = df.withColumn("_p", F.expr(f"transform(_l, (x, i) -> IF(get(_b, i - 1) <=> get(_b, i), 0, CAST(shiftright({pair}, 32) AS INT)))"))
    spread = "flatten(transform(_p, (h, i) -> array_repeat(h, get(_b, i) - coalesce(get(_b, i - 1), -1))))"
    df = df.withColumn(name, F.expr(f"IF(size(_l) = 0, CAST(array() AS array<int>), concat({spread}, array_repeat(get(_p, 0), {BINS - 1} - get(_b, size(_b) - 1))))"))
    return df.select(*cols, name)


def likeness(a: str, b: str) -> Column:
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> IF(x <=> y, 1, 0)), 0, (n, x) -> n + x)"
    return F.expr(f"IF(size({a}) + size({b}) = 0, 1D, {same} / {float(BINS)}D)")


def as_text(signature: str) -> Column:
    return F.expr(f"lower(array_join(transform({signature}, h -> lpad(hex(h & 4294967295L), 8, '0')), ''))")


def beside_next(docs: DataFrame, order: str, tie: str, next_of: dict[str, str], narrow: DataFrame) -> DataFrame:
    """docs with, for each `column: name` of next_of, the column of the next row in descending order (after the last: of
    the first). narrow: the order column alone, from which the quantiles are taken."""
    n = narrow.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET))
    # percentile_approx takes constants only, which a transformed sequence isn't
    shares = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets + 1))), ",").cast("array<double>")
    cuts = sorted(set(narrow.agg(F.percentile_approx(order, shares, max(10_000, 4 * buckets))).first()[0] or [NO_ID]))
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded to one constant
    docs = docs.withColumn("_cuts", listed).withColumn("_at", F.expr(f"aggregate({STEPS.format('_cuts')}, 0, (n, step) -> IF(n + step <= size(_cuts) AND get(_cuts, n + step - 1) < {order}, n + step, n))"))
    marked = F.expr(f"IF(get(_cuts, _at) = {order}, array(struct(_at AS b, 0 AS m), struct((_at + 1) % {len(cuts)} AS b, 1 AS m)), array(struct(_at AS b, 0 AS m)))")
    dealt = docs.withColumn("_p", F.explode(marked)).drop("_cuts", "_at")
    window = Window.partitionBy("_p.b").orderBy(F.col("_p.m"), F.desc(order), tie)
    return dealt.withColumns({name: F.lead(c).over(window) for c, name in next_of.items()}).where("_p.m = 0").drop("_p")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many, or all, from the start
    of the next document in descending doc_id.
    """
    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("o"), text.alias("text"))
    signed = with_signature(rows, "text", "sig").withColumn("tie", F.xxhash64("text"))
    both = beside_next(signed, "o", "tie", {"text": "next_text", "sig": "next_sig"}, rows.select("o"))
    both = both.select("doc_id", "sig", "next_sig", F.char_length("text").cast("long").alias("n_chars"), "text", "next_text")
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 2 AS INT)), substring(next_text, 1, CAST(n_chars div 2 AS INT)))"))
    both = with_signature(both.select("doc_id", "sig", "next_sig", "n_chars", "edited"), "edited", "edited_sig")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
