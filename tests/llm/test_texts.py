"""The operators on texts, against brute force, on a small corpus with nulls, ties, repeats and long texts."""

import functools
import hashlib
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vexel.llm import bpe, exact_dedup, fingerprints, hash_index, language_id, line_dedup, mixing, near_dedup, substring_dedup, token_files, transducer, url_filter

LONG = "The long line that is repeated in many documents of this small corpus"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, row string, keep_id string, hi string, gone string"


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n\t ", "one", "A b\x0bC", "x" * 3000, "12 34", "日本語 テスト 日本語"]
    for i in range(40):
        words = [word() for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20) : 50]
        if i % 7 == 0:
            words += words
        text = " ".join(words)
        texts.append(text + "\n  " + LONG + " \n" + LONG.upper() + "\nend" if i % 4 == 0 else text)
    texts += [texts[10], texts[10], texts[20] + " tail", "  " + texts[21].replace(" ", "  "), " ".join(["same"] * 5000)]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    docs += [docs[12], (None, texts[13]), (None, None)]  # a repeated row, and rows without id
    rng.shuffle(docs)
    return docs


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "d", "f", "r", "k", "h", "g") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(i):
    return -(2**63) if i is None else i


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.decisions(spark, docs).collect()
    assert len(got) == len(DOCS)
    groups = {}
    for i, t in DOCS:
        groups.setdefault(sha(t or ""), []).append(i)
    kept = {}
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and order(r["keep_id"]) == max(map(order, ids))
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert exact_dedup.decisions(spark, empty).count() == 0
    stayed = exact_dedup.keep_distinct(spark, docs)
    assert stayed.columns == docs.columns and stayed.count() == len(groups)


def test_exact_dedup_index_persists(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.keep_distinct(spark, docs, index).count()
    assert first > 0 and exact_dedup.keep_distinct(spark, docs, index).count() == 0
    plan = index.unseen(exact_dedup.digests(docs).groupBy("digest").agg(exact_dedup.group_mark()))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.index("LeftAnti") < plan.index("Aggregate") < plan.index("Exchange")  # aggregated, shuffled, joined


def test_line_dedup(spark, docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = {}
    for i, t in DOCS:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(order(i))
    want = []
    for i, t in DOCS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != order(i))]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    index = line_dedup.line_index(spark, docs)
    assert rows(line_dedup.drop_lines(docs, index, columns=("kept_sha256",))) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 5
    assert line_dedup.drop_lines(empty, line_dedup.line_index(spark, empty)).count() == 0


def test_hash_index_finds_all_and_only_its_keys(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (3000, 2))
    table = spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(keys[:2000])], "hi long, lo long, n long")
    index = hash_index.HashIndex.build(spark, table, 2000, {"n": "uint16"}, shard_keys=300)
    hi, lo = (np.ascontiguousarray(keys[:, k]).view(np.uint64) for k in (0, 1))
    found, value = index.find(hi, lo)
    assert found[:2000].all() and not found[2000:].any() and (value["n"][:2000] == np.arange(2000)).all()
    perfect = hash_index.PerfectHash.build(hi)
    assert sorted(perfect.number(hi)) == list(range(3000))
    with pytest.raises(RuntimeError):
        hash_index.HashIndex.build(spark, table, 2001, {"n": "int64"}, shard_keys=300)
    hash_index._kept.clear()
    shutil.rmtree(index.path.removeprefix("file://") + "/shard=3")  # a lost shard is no empty one
    with pytest.raises((FileNotFoundError, RuntimeError)):
        index.find(hi, lo)
    with pytest.raises(ValueError):
        hash_index.file_system("/shared/index")


def test_substring_dedup(spark, docs, empty):
    seen, starts = {}, []
    for i, t in DOCS:
        w = words_of(t)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            seen[k] = min(seen.get(k, (order(i), s)), (order(i), s))
            starts.append(k)
    want = []
    for i, t in DOCS:
        w = words_of(t)
        gone = {j for s in range(len(w) - 19) if seen[tuple(w[s : s + 20])] != (order(i), s) for j in range(s, s + 20)}
        want.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert sum(w[2] for w in want) > 500
    assert rows(substring_dedup.drop_repeats(spark, docs, columns=("kept_sha256",))) == sorted(want, key=repr)
    assert substring_dedup.drop_repeats(spark, empty).count() == 0


def test_substring_dedup_of_hot_anchors(spark, docs):
    index = substring_dedup.recurring_anchors(spark, docs)
    hot = substring_dedup.segments(docs, index, hot=2)
    assert hot.where("size(split(words, ' ')) > 20").count() == 0
    cool = substring_dedup.segments(docs, index)
    windows = lambda df: df.selectExpr("d", "th", "explode(sequence(start, start + size(split(words, ' ')) - 20)) AS s").distinct().count()
    assert windows(hot) == windows(cool) > 0


def test_simhash(spark, docs, empty):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = []
    for i, t in DOCS:
        w = words_of((t or "").translate(lower))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h)))
    names = list(range(len(DOCS)))
    for a in range(len(DOCS)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = names[a], names[b]
                names = [new if n == old else n for n in names]
    least = {}
    for n, (i, _) in zip(names, DOCS):
        if i is not None:
            least[n] = min(least.get(n, i), i)
    want = [(i, p - (1 << 64) if p >> 63 else p, least.get(n)) for n, (i, _), p in zip(names, DOCS, prints)]
    assert rows(near_dedup.near_duplicates(spark, docs)) == sorted(want, key=repr)
    assert near_dedup.near_duplicates(spark, empty).count() == 0
    stayed = near_dedup.keep_one(spark, docs)
    assert stayed.columns == docs.columns
    assert sorted(r["doc_id"] for r in stayed.where("doc_id IS NOT NULL").collect()) == sorted(least.values())


def test_simhash_links_through_chains_and_large_buckets(spark):
    rng = np.random.default_rng(5)
    values = [0]
    for _ in range(300):  # a chain, each link within 4 bits of the one before
        values.append(values[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    values += [int(x) for x in rng.integers(0, 2**63, 200)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for pretended, bucket in ((len(signed), 2048), (50_000_000, 2048), (len(signed) >> 20, 10)):  # other blocks, or buckets in parts: same links
        roots = {r["node"]: r["root"] for r in near_dedup.components(spark, near_dedup.links(spark, frame, pretended, bucket=bucket)).collect()}
        names = {v: v for v in signed}
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and names[a] != names[b]:
                    old, new = max(names[a], names[b]), min(names[a], names[b])
                    names = {k: new if n == old else n for k, n in names.items()}
        assert {v: roots.get(v, v) for v in signed} == names
    near = np.array([0] + [1 << b for b in range(40)] + [(1 << 40) - 1], np.uint64)
    table = np.bitwise_count(near[:, None] ^ near_dedup.pivots()).astype(np.int8)
    by = np.argsort(table[:, 0], kind="stable")
    assert len(near_dedup._search(near[by], table[by], 4)) == 40


def spark_hash(*parts):
    """xxhash64 of longs, ints (as pairs with their width) and strings, each seeded with the hash before."""
    h = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p[0].to_bytes(p[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def signature(text):
    """As the definition has it: from each arc's beginning, the next two numbered k-mers on the circle, in text order."""
    words = [(spark_hash(w), 8) for w in words_of(text)]
    if not words:
        return []
    grams = [spark_hash(*words[i : i + 5]) for i in range(len(words) - 4)] or [spark_hash(*words)]
    seen, items = {}, []
    for i, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        items.append((spark_hash((g, 8), (n, 4)) if n else g, i))
    out = []
    for k in range(64):
        begin = -(2**63) + k * 2**58
        near = sorted(items, key=lambda x: (x[0] - begin) % 2**64)[:2]
        out.append(spark_hash(*[(h, 8) for h, _ in sorted(near, key=lambda x: x[1])]) >> 32)
    return out


def same(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b)) / 64


def test_fingerprints(spark, docs, empty):
    """All columns by brute force, but where rows that share a doc_id make the next document a matter of hashes."""
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(DOCS)
    ordered = sorted(((i, t or "") for i, t in DOCS), key=lambda d: (-order(d[0]), spark_hash(d[1])))
    want = []
    for k, (i, t) in enumerate(ordered):
        u = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = signature(t), signature(edited), signature(u)
        hexed = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in s)
        want.append((i, len(t), sha(edited), hexed(a), hexed(b), same(a, b), same(a, c)))
    assert rows(fingerprints.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == sorted(want, key=repr)
    assert len({r["fingerprint"] for r in got}) >= 0.9 * len({" ".join(words_of(t)) for _, t in DOCS})
    assert fingerprints.fingerprints(empty).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 1999, 2000, 5000])
def test_next_documents_in_any_number_of_buckets(spark, monkeypatch, buckets):
    """Larger tables have thousands of buckets."""
    monkeypatch.setattr(fingerprints, "BUCKET", 1)
    monkeypatch.setattr(fingerprints, "MOST_BUCKETS", buckets)
    data = spark.range(0, 15_000, 3).selectExpr("id AS o", "CAST(id AS string) AS text")
    got = fingerprints.beside_next(data, "o", "text", {"text": "next_text"}, data.select("o")).collect()
    assert sorted((r["o"], r["next_text"]) for r in got) == [(i, str((i - 3) % 15_000)) for i in range(0, 15_000, 3)]


def test_fingerprint_by_brute_force(spark):
    """Signatures as the definition has them, for texts with repeated k-mers."""
    texts = ["a b c d e f g h i j a b c d e f g h", " ".join("xy"[i % 2] for i in range(60)), "a b", "q " * 9, "q " * 3000, "", "one two three four five six"]
    for r in fingerprints.with_signature(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "sig").collect():
        assert r["sig"] == signature(r["text"])


@pytest.mark.parametrize("n", [12, 30, 60, 300])
def test_fingerprints_tell_order(spark, n):
    """Texts whose halves change places keep most k-mers, but not their order."""
    rng = random.Random(n)
    pairs = []
    for k in range(40):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        pairs.append((k, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
    signed = fingerprints.with_signature(fingerprints.with_signature(spark.createDataFrame(pairs, "k long, a string, b string"), "a", "sa"), "b", "sb")
    likeness = [r[0] for r in signed.select(fingerprints.likeness("sa", "sb")).collect()]
    kept = n - 8  # of n - 4 k-mers
    assert np.mean(likeness) < 0.8 * kept / (2 * (n - 4) - kept)  # and of the k-mers' Jaccard


def test_language_id(spark, docs, empty):
    rng = random.Random(1)
    teach = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "zwei drei vier fünf sechs sieben acht".split()}
    made = [(i, " ".join(rng.choices(teach[x], k=30)), x) for i, x in enumerate(["aa", "bb"] * 150)]
    table = spark.createDataFrame([*made, (None, "x", "aa"), (900, None, "bb"), (901, "12 !", "aa"), (902, "дом", None)], "doc_id long, text string, lang string")
    model = language_id.fit(table)
    got = {r["doc_id"]: r for r in language_id.predictions(table, model).collect()}
    assert all(got[i]["lang_pred"] == x and got[i]["score"] > 0.6 for i, _, x in made)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in made)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] in teach and got[902]["score"] < 0.6
    assert language_id.keep_known(table, model).where("doc_id < 900").count() == len(made)
    assert language_id.keep_known(table, model).where("doc_id IN (900, 901)").count() == 0
    assert {r["lang_pred"] for r in language_id.predictions(docs, language_id.fit(docs)).collect()} == {"und"}
    assert language_id.predictions(empty, model).count() == 0
    assert language_id.keep_known(docs, model).columns == docs.columns


def test_bloom_false_positives_are_corrected():
    slots, n = np.zeros(language_id.SLOTS, np.uint64), 200_000
    keys = np.random.default_rng(0).integers(0, 2**64, 2 * n, np.uint64)
    for s in language_id._slots(keys[:n]):
        slots[s] |= np.uint64(1)
    false = slots.astype(bool).mean() ** language_id.HASHES
    hit = np.logical_and.reduce([slots[s] for s in language_id._slots(keys[n:])]).mean()
    assert abs(hit - false) < 0.01 < false


VOCABULARY = "byte_bpe_50k.json"
ODD = ["", " ", "a  b", "a   b ", "  a\n \n b", "<|endoftext|>", "a <|endoftext|> b", "a\t b", "don't  you'll", "日本語", "a" * 3000, "ab" * 200 + "  é", "\x1c \x1d", " \x85 x", "né́e", "👍🏽 👍", "a\x00b", "\r\n \r\n", "x " * 3]


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path(name))


def test_bpe(spark, docs, empty):
    encoder, real = bpe.Encoder(spark, bpe.vocabulary_path(VOCABULARY), docs, words=100), tokenizer(VOCABULARY)
    want = []
    for i, t in DOCS:
        ids = real.encode(t or "", add_special_tokens=False).ids
        back = real.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, back, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(back)))
    assert rows(encoder.encode(docs, ("ids", "decoded", "ids_sha256", "decoded_sha256"))) == sorted(want, key=repr)
    assert encoder.encode(empty).count() == 0


def test_bpe_of_odd_texts(tmp_path):
    spec, real = bpe.read_vocabulary(bpe.vocabulary_path(VOCABULARY)), tokenizer(VOCABULARY)
    listed = sorted({b" the", b"the", b"a", b" a", b" b", "日".encode()})
    bare = spec["arrays"] | transducer.compile_words([]) | {"ids": np.zeros(0, np.int32), "ids_at": np.zeros(1, np.int64)}
    at = np.cumsum([0, *map(len, listed)])
    flat, first, n = transducer.Lexicon(bare).encode(np.frombuffer(b"".join(listed), np.uint8), at[:-1], np.diff(at))
    transducer.save(str(tmp_path / "l"), spec["arrays"] | transducer.compile_words(listed) | {"ids": transducer.pieces(flat, first, n, np.arange(len(listed))), "ids_at": np.concatenate([[0], np.cumsum(n)])})
    codec, rng = bpe.Codec(str(tmp_path / "l"), spec["special"]), random.Random(1)
    texts = ODD + ["".join(rng.choices(" \n\t ab'sté1²😀.,<|>  \x0b\x1f", k=rng.randint(0, 50))) for _ in range(500)]
    ids, at = codec.encode(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, at, at[1:]):
        want = real.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want and codec.decode(ids[a:b]).decode() == real.decode(want, skip_special_tokens=False)


def test_transducer_is_minimal_and_ranks_words():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b""})
    arrays = transducer.compile_words(words)
    assert len(arrays["accepts"]) < sum(map(len, words)) and len(arrays["edge_key"]) <= 9
    lexicon = transducer.Lexicon(arrays | {"pair_key": np.zeros(0, np.int64), "pair_slot": transducer.Table.build(np.zeros(0, np.int64)).slots, "merged": None, "byte_id": None})
    asked = [*words, b"to", b"stopss", b"x"]
    at = np.cumsum([0, *map(len, asked)])
    assert lexicon.walk(np.frombuffer(b"".join(asked), np.uint8), at[:-1], np.diff(at)).tolist() == [*range(len(words)), -1, -1, -1]


def test_token_files(spark, docs, empty, tmp_path):
    path, real = bpe.vocabulary_path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    files = token_files.write_tokens(docs, f"file://{tmp_path}/t", path, roll=0).cache()
    assert files.where("number > 0").count() > 0  # files are closed, and others opened
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r["start"])
    assert [order(r["doc_id"]) for r in got] == sorted(order(i) for i, _ in DOCS)
    start, want = 0, {}
    for i, t in DOCS:
        ids = real.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, f"file://{tmp_path}/e", path)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits, tmp_path):
    ids = np.random.default_rng(0).integers(0, 2**32, 150_001, np.uint64).astype(np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, bits), len(ids)) == ids).all()
    import pyarrow.fs as fs

    local = fs.LocalFileSystem()
    with local.open_output_stream(str(tmp_path / "f")) as sink:
        writer = token_files.Writer(sink, bits)
        writer.add([7, None], ids[:70_000], np.array([5, 70_000]))
        writer.add([9], ids[70_000:], np.array([len(ids) - 70_000]))
        writer.close()
    reader = token_files.Reader(local.open_input_file(str(tmp_path / "f")))
    assert reader.index["doc_ids"] == [7, None, 9] and reader.index["starts"] == [0, 5, 70_000, len(ids)]
    for a, b in ((0, 0), (0, 5), (65_530, 65_540), (60_000, 140_000), (0, len(ids))):
        assert (reader.ids(a, b) == ids[a:b]).all()


def test_words_encode_alone_as_in_texts():
    path, real = bpe.vocabulary_path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    rng = random.Random(2)
    texts = [t or "" for _, t in DOCS] + ODD + ["H\u0331 I\u0307x"] + ["".join(rng.choices(" \n\tAB'sTé1²H\u0331I\u0307<|endoftext|>.,", k=40)) for _ in range(300)]
    ids, at = token_files.encode_words(path, pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == real.encode(t, add_special_tokens=False).ids


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8/9", "http://e.example.net/de/7", "ftp://x.org/es/é", "http://x.org?/es/", "http://x.org#/es/", "a://b://org/es/", "http://x.org/es/\n/z", "http://org./es/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls + [urls[4]])] + [(None, urls[4], "", "")], "page_id long, url string, host string, row string")
    want = []
    for i, u in [*enumerate(urls + [urls[4]]), (None, urls[4])]:
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    assert rows(url_filter.verdicts(spark, pages)) == sorted(want, key=repr)
    assert url_filter.verdicts(spark, pages.limit(0)).count() == 0
    listed = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    assert rows(url_filter.verdicts(spark, pages, listed)) == sorted(want, key=repr)
    assert {r["verdict"] for r in url_filter.verdicts(spark, pages, [], "block").collect()} == {"block"}


def test_mixing(spark, docs, empty):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(50)]
    made, labels = [], []
    for i in range(600):
        kind = ["clean", "clean", "clean", "low", "toxic"][i % 5]
        words = rng.choices(common, k=20) + {"clean": [], "low": ["|", "|"], "toxic": rng.choices(["bad", "worse"], k=3)}[kind]
        made.append((i, " ".join(words), "s", 9.0))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    table = spark.createDataFrame(made, "doc_id long, text string, source string, rate double")
    labelled = spark.createDataFrame([*labels, (None, 1, 0), (5000, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.rates(spark, table, labelled).collect()
    total = {n: sum(r["expected_tokens"] * r[f"p_{n}"] for r in got) for n in mixing.DOMAINS}
    was = sum(r["n_tokens"] * r["p_clean"] for r in got)
    assert abs(total["clean"] / was - 1) < 0.01 and abs(total["low"] / total["clean"] * 0.95 / 0.05 - 1) < 0.02 and total["toxic"] < 0.01 * was
    assert all(r["rate"] >= 0 and abs(sum(r[f"p_{n}"] for n in mixing.DOMAINS) - 1) < 1e-9 for r in got)
    mixed = mixing.mix(spark, table, labelled, pull=1e-3, most=1)
    ids = {r["doc_id"] for r in mixed.collect()}
    assert mixed.count() == len(ids)
    doubled = mixing.mix(spark, table, labelled, budget=2.0, number="nth")
    assert doubled.columns == [*table.columns, "nth"] and doubled.select("doc_id", "nth").distinct().count() == doubled.count() > 1.8 * mixed.count()
    assert mixed.columns == table.columns and {i for i in range(600) if i % 5 < 3} <= ids and not {i for i in range(600) if i % 5 == 4} & ids
    assert mixing.rates(spark, empty, labelled).count() == 0 and mixing.mix(spark, empty, labelled).count() == 0
    assert mixing.rates(spark, docs, labelled.limit(0)).count() == len(DOCS)


def least_squares(p, t, target, rounds=200_000):
    """Accelerated projected gradient in the rates themselves, restarted when the fit gets worse."""
    a = (t / t.sum())[:, None] * p
    step = 1 / np.linalg.norm(a, 2) ** 2
    rate, ahead, m, best = np.ones(len(p)), np.ones(len(p)), 1.0, np.inf
    for _ in range(rounds):
        new = np.maximum(0, ahead - step * (a @ (ahead @ a - target / t.sum())))
        now = np.linalg.norm(new @ a - target / t.sum())
        m = 1.0 if now > best else (1 + np.sqrt(1 + 4 * m * m)) / 2
        ahead = new + (0 if m == 1.0 else (m - 1) / m) * (new - rate)
        rate, best = new, now
        if now < 1e-12:
            break
    return np.linalg.norm((rate * t) @ p - target)


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.25, "c": 0.05}, {"a": 0.95, "b": 0.05, "c": 0.0}, {"a": 0.0, "b": 0.5, "c": 0.5}])
def test_rates_against_brute_force(spark, weights):
    """Targets that rates can reach, and one (no c at all, though every document may be c) that they can't."""
    rng = np.random.default_rng(0)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300) * 0.97 + 0.01, rng.integers(1, 100, 300)
    names, share = ["a", "b", "c"], np.array([*weights.values()])
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "n_tokens long, p_a double, p_b double, p_c double")
    steps = mixing.fit_rates(members, names, weights)
    rate = np.array([r[0] for r in members.select(mixing.rate_of(steps, names)).collect()])
    target = (t @ p)[0] * share / share[0] if share[0] else t.sum() * share
    mine = np.linalg.norm((rate * t) @ p - target)
    assert (rate >= 0).all() and mine <= 1.01 * least_squares(p, t, target) + 1e-4 * t.sum() / 100
    capped = mixing.fit_rates(members, names, weights, most=1, pull=1e-6)
    assert max(r[0] for r in members.select(mixing.rate_of(capped, names, 1)).collect()) <= 1


def test_posteriors_by_brute_force(spark):
    """Naive Bayes, word by word."""
    texts = [(0, "a b , c"), (1, "A  a x"), (2, ""), (3, None), (4, "c! c\nb")]
    model = mixing.DomainClassifier(["m", "n"], ["a", ",", "!", "b"], np.array([-1.0, -2.0]), np.array([[0.5, -0.25], [2.0, 1.0], [-1.5, 3.0], [0.1, 0.2]]))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in model.posteriors(mixing.text_or_empty(frame), frame).collect()}
    for i, text in texts:
        has = set(re.sub(r"([^\w\s]+)", r" \1 ", (text or "").lower()).split())
        score = np.array([-1.0, -2.0]) + sum(w for x, w in zip(model.words, model.present) if x in has)
        want = np.exp(score) / np.exp(score).sum()
        assert abs(got[i]["p_m"] - want[0]) < 1e-12 and abs(got[i]["p_n"] - want[1]) < 1e-12


def test_exact_dedup_index_keeps_its_buckets(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=16)
    exact_dedup.keep_distinct(spark, docs, index, "one")
    for buckets in (8, 32):
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=buckets)
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    assert again.buckets == 16 and exact_dedup.keep_distinct(spark, docs, again, "two").count() == 0


def test_exact_dedup_batch_that_is_run_again(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    exact_dedup.keep_distinct(spark, docs.where("doc_id < 30"), index, "first")
    kept = rows(exact_dedup.keep_distinct(spark, docs, index, "second").select("doc_id", "text"))  # its output is lost
    size = index.read().count()
    assert rows(exact_dedup.keep_distinct(spark, docs, index, "second").select("doc_id", "text")) == kept and index.read().count() == size == index.read().select("digest").distinct().count()


def test_simhash_keeps_different_texts_that_share_a_doc_id(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(2))
    frame = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (None, a), (None, "alone here")], "doc_id long, text string")
    assert rows(near_dedup.keep_one(spark, frame)) == sorted([(3, a), (5, b), (None, "alone here")], key=repr)


def test_language_counts_by_brute_force(spark, docs):
    """Every n-gram of every text, one at a time, against the slots."""
    teach = {"aa": ["abc dea ecb", "cab bad"], "bb": ["été née", "décédé cé"]}
    made = [(i, t * 20, x) for i, (t, x) in enumerate([(t, x) for x, ts in teach.items() for t in ts] * 4) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = language_id.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    mask = 2**64 - 1
    got = {(r["doc_id"], r["score"], r["lang_pred"], round(r["known"], 12)) for r in language_id.predictions(docs, model).collect()}
    want = set()
    for i, t in DOCS:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        text = " " + "".join(w + " " for w in words)
        n, known = 0, np.zeros(2)
        for size in language_id.SIZES:
            for k in range(len(text) - size + 1):
                h = size
                for c in text[k : k + size]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
                h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & mask
                h ^= h >> 32
                hit = functools.reduce(int.__and__, (int(model.slots[(h >> 20 * j) & (language_id.SLOTS - 1)]) for j in range(language_id.HASHES)))
                n, known = n + 1, known + [hit & 1, hit >> 1 & 1]
        true = np.maximum(0, (known - n * model.false) / (1 - model.false))
        top, total = true.max(), true.sum()
        score = top / total if words and total else 0.0
        want.add((i, score, model.langs[true.argmax()] if words else "und", round(min(1, top / n), 12) if words and n else 0.0))
    assert sorted({(*r[:1], round(r[1], 9), *r[2:]) for r in got}, key=repr) == sorted({(*r[:1], round(r[1], 9), *r[2:]) for r in want}, key=repr)


def test_long_texts(spark, tmp_path):
    """A text of 9 MB, more than any operator takes at once, gives what its parts say."""
    rng = random.Random(8)
    vocabulary = [f"{rng.choice('abcdé')}{i:x}," for i in range(5000)]
    words = rng.choices(vocabulary, k=1_500_000)
    words[700_000:700_100] = words[100:200]
    words[1_400_000:1_400_050] = words[120:170]
    long = "\n".join(" ".join(words[k : k + 30]) for k in range(0, len(words), 30))
    assert len(long.encode()) > 8_500_000
    docs = spark.createDataFrame([(1, "a short one"), (2, long), (3, " ".join(words[300:400])), (4, None)], "doc_id long, text string").coalesce(1)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}

    seen, gone = {}, np.zeros(len(words) + 1, np.int64)
    for s in range(len(words) - 19):
        if seen.setdefault(tuple(words[s : s + 20]), s) != s:
            gone[s] += 1
            gone[s + 20] -= 1
    kept = [w for w, g in zip(words, np.cumsum(gone)) if not g]
    got = by(substring_dedup.drop_repeats(spark, docs, columns=("kept_sha256",)))
    assert (got[2]["n_words"], got[2]["n_removed"], got[2]["kept_sha256"]) == (len(words), len(words) - len(kept), sha(" ".join(kept))) and 100 <= got[2]["n_removed"] < 500
    assert got[3]["n_removed"] == 100 and got[1]["n_removed"] == got[4]["n_words"] == 0

    prints = by(near_dedup.with_fingerprint(docs))
    sums, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    hashes = np.array([digest(" ".join(words[k : k + 4]), 42) for k in range(len(words) - 3)], np.uint64)
    for b in range(64):
        sums[b] = int((hashes >> np.uint64(b) & np.uint64(1)).sum())
    assert prints[2]["fp"] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sums[b] > len(hashes))

    teach = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([("abc dea a1 b2 cd", "aa"), ("zz yy xx ww", "bb")] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(teach)
    whole, parts = by(language_id.predictions(docs, model))[2], [np.zeros(1), np.zeros((1, 2)), np.zeros(1)]
    points, number, letters = language_id._normal([long])
    for h, at in language_id._grams(points, number):
        n, known = model.tally([(h, at)], 1)
        parts[0], parts[1] = parts[0] + n, parts[1] + known
    langs, score, known = model.decide(parts[0], parts[1], letters)
    assert (whole["lang_pred"], whole["score"], whole["known"]) == (langs[0], score[0], known[0])

    path = bpe.vocabulary_path("word_bpe_49k.json")
    ids = tokenizer("word_bpe_49k.json").encode(long, add_special_tokens=False).ids + [1]
    read = by(token_files.read_tokens(spark, token_files.write_tokens(docs, f"file://{tmp_path}/t", path)))
    assert (read[2]["n_tokens"], read[2]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert read[3]["start"] == read[2]["start"] + len(ids) and read[4]["n_tokens"] == 1

    real = tokenizer(VOCABULARY)
    ids = real.encode(long, add_special_tokens=False).ids
    coded = by(bpe.Encoder(spark, bpe.vocabulary_path(VOCABULARY), docs, words=100).encode(docs, ("ids_sha256", "decoded_sha256")))
    assert (coded[2]["n_tokens"], coded[2]["ids_sha256"], coded[2]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(long))

    dropped = by(line_dedup.drop_lines(docs, line_dedup.line_index(spark, docs), columns=("kept_sha256",)))
    assert dropped[2]["n_lines"] == 50_000 and dropped[2]["kept_sha256"] == sha(long)
