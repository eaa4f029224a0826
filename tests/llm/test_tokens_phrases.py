"""Operators 11 to 13 on small cases, against whole-text encoding, a plain merge and plain counting."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from importlake.llm import alignment, collocations, common, encoding, registry, token_files
from tests.llm.test_llm import none, odd, odd_rows, prose  # noqa: F401

SF = "/root/testdata/sf0.001"
PARTS = ["^ ^", "^", "a", "b", "don't", " ", "  ", "\n", "\t", "é", "ß", "x1", ".", "!", ",", "<|endoftext|>", " ", " ", "\x1c", "\x85", "漢字", "😀", "<s>", "'", "²", "Ⅷ", "１", " word", "und", "\x00"]


def odd_texts(n, seed, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_level():
    return {plain: encoding.ByteLevel(registry.byte_level_path(), plain) for plain in (False, True)}


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_encode_like_whole_texts(byte_level, plain):
    known = byte_level[plain]
    texts = odd_texts(3000, 1) + [prose(2000, 5)]
    for t, ids in zip(texts, known.texts(texts)):
        assert np.frombuffer(ids, known.kind).tolist() == known.whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert known.texts([None, ""]) == [b"", b""]


def test_chunks_are_forgotten_when_too_many():
    known = encoding.ByteLevel(registry.byte_level_path(), most=10)
    texts = [prose(50, k) for k in range(5)]
    for t in texts:
        assert np.frombuffer(known.texts([t])[0], known.kind).tolist() == known.whole.encode(t, add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts():
    known = encoding.SentencePieces(registry.vocabulary_path())
    for t in odd_texts(3000, 2):
        assert np.frombuffer(b"".join(known.of(encoding.CUT.split(t))), known.kind).tolist() == known.model.encode(t), repr(t)


@pytest.mark.parametrize("top", [0, 1, 7, 1000, 10**6, 2**40, 2**63 - 1])
def test_elias_fano_selects_any_range(top):
    rng = random.Random(top)
    for n in (1, 2, 255, 256, 257, 1500):
        values = np.sort(np.array([rng.randint(0, top) for _ in range(n)], np.uint64))
        n_, bits, *parts = token_files.Code.pack(values)
        blob = b"".join(parts)
        asked = []

        def read(at, size):
            assert 0 <= at and 0 <= size and at + size <= len(blob)
            asked.append(size)
            return blob[at : at + size]

        code = token_files.Code(n, bits, tuple(map(len, parts)), read)
        for _ in range(20):
            i = rng.randint(0, n)
            j = rng.randint(i, n)
            assert code.select(i, j).astype(np.uint64).tolist() == values[i:j].tolist()
        if top and n > 1000:
            assert len(blob) * 8 < n * (2 + max(0, np.log2(top / n)) + 1) + 32 * (n / token_files.STEP + 2) + 64  # near the bound, not 64 bits a value
            asked.clear()
            code.select(n // 2, n // 2 + 1)
            assert sum(asked) < 300  # a few bytes


def test_files_of_ids(spark, odd, byte_level, tmp_path):  # noqa: F811
    folder = f"file://{tmp_path}/ids"
    files = token_files.write(odd, folder, registry.byte_level_path(), most_docs=3)
    got = token_files.read(spark, folder, files, block=2).collect()
    whole = byte_level[False].whole
    want = sorted(((d, whole.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, *_ in odd_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    starts = np.append(0, np.cumsum([len(i) for _, i in want]))
    assert sorted((r.start, r.doc_id, list(r.ids)) for r in got) == [(int(s), d, i) for s, (d, i) in zip(starts, want)]
    checks = token_files.checks(spark, folder, files).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in checks) == [(int(s), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, (_, i) in zip(starts, want)]
    assert files.agg(F.max("n_docs")).first()[0] == 3 and not [p.name for p in (tmp_path / "ids").iterdir() if p.name.startswith(".")]


def test_a_run_again_writes_the_same_files(spark, odd, tmp_path):  # noqa: F811
    for _ in range(2):
        files = token_files.write(odd, f"file://{tmp_path}/ids", registry.byte_level_path())
    assert {r["file"] for r in files.collect()} == {p.name for p in (tmp_path / "ids").iterdir()}


def test_extreme_doc_ids(spark, tmp_path):
    ids = [-(2**63), -5, 0, 2**53 + 1, 2**63 - 1]
    files = token_files.write(spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string"), f"file://{tmp_path}/ids", registry.byte_level_path())
    assert [r.doc_id for r in sorted(token_files.checks(spark, f"file://{tmp_path}/ids", files).collect(), key=lambda r: r.start)] == ids


def test_empty_table_gives_no_file(spark, none, tmp_path):  # noqa: F811
    files = token_files.write(none, f"file://{tmp_path}/ids", registry.byte_level_path())
    assert files.count() == 0 and token_files.checks(spark, f"file://{tmp_path}/ids", files).count() == 0


def random_ends(rng, n, top):
    a, b = (sorted(rng.sample(range(1, top), min(n, top - 1))) for n in (rng.randrange(0, n), rng.randrange(0, n)))
    return np.array(a + [top]), np.array(b + [top])


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 512])
def test_merge_path_pieces(work):
    rng = random.Random(work)
    for _ in range(150):
        a, b = random_ends(rng, 60, rng.choice([70, 100, 400]))
        i, j, until = alignment.pieces(a, b, work)
        assert (np.diff(until) <= work).all() and (i + j - np.arange(len(i)) * work <= 1).all()  # equal work, but for an end that both share
        o = alignment.merge(a, b, work)
        start = lambda ends, k: int(ends[k - 1]) if k else 0
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if start(a, x) < b[y] and start(b, y) < a[x]]
        assert list(zip(o.i.tolist(), o.j.tolist())) == want
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert o.group_a.tolist() == [sum(c < e for c in both) for e in a.tolist()] and o.group_b.tolist() == [sum(c < e for c in both) for e in b.tolist()]


def aligned_by_hand(texts):
    """As the operator's rows, one token at a time; no chunk, piece or table."""
    known, model = encoding.ByteLevel(registry.byte_level_path(), True), encoding.SentencePieces(registry.vocabulary_path())
    rows, counts = [], Counter()
    for t in texts:
        a, b = (known.whole.encode(" " + t, add_special_tokens=False).ids, model.model.encode(t)) if t else ([], [])
        spelled = {b"".join(known.bytes[i] for i in a), b"".join(model.bytes[i] for i in b)}
        if not t or spelled != {(" " + t).encode()}:
            rows.append(None)
            continue
        owner = [[k for k, i in enumerate(ids) for _ in of[i]] for ids, of in ((a, known.bytes), (b, model.bytes))]
        links = list(dict.fromkeys(zip(*owner)))
        ends = [set(np.cumsum([len(of[i]) for i in ids]).tolist()) for ids, of in ((a, known.bytes), (b, model.bytes))]
        groups, at = [], 0
        for e in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(o[at:e])) for ids, o in ((a, owner[0]), (b, owner[1]))))
            at = e
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(set(pairs))
        rows.append((len(a), len(b), len(groups), pairs, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(counts[p] == best[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in rows]


@pytest.mark.parametrize("most", [500_000, 40, 0])
def test_alignment_equals_brute_force(spark, most):
    texts = [None, "", " ", "▁", "a ▁ b", "same text", "same text", prose(3000, 3), *odd_texts(60, 3, PARTS + ["▁"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "pair", "n", "a", "groups", "n_a")})
    got = alignment.align(docs.repartition(3), registry.byte_level_path(), registry.vocabulary_path(), most=most).collect()
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got}
    assert len(got) == len(texts) and [rows[k] for k in range(len(texts))] == aligned_by_hand(texts)


def test_alignment_of_odd_rows(spark, odd, none):  # noqa: F811
    digests = alignment.align(odd, registry.byte_level_path(), registry.vocabulary_path(), digest=True).collect()
    texts = alignment.align(odd, registry.byte_level_path(), registry.vocabulary_path()).collect()
    assert sorted(r.groups for r in digests) == sorted(hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in texts)
    assert len(digests) == len(odd_rows()) and alignment.align(none, registry.byte_level_path(), registry.vocabulary_path()).count() == 0


def mined_by_hand(rows, least, share, longest=5):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        for p, a in cands.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                out.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
    return sorted(out)


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "of", "x", "ÄB", "äb", "is", "very", "rare", " ", "a b"]
    phrase = "One two THREE four five six"
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", "\x0b"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None]), rng.choice([text, text + phrase, phrase + "! " + phrase, None, ""])))
    return rows


@pytest.mark.parametrize("shards, slots, share", [(1, 1 << 12, 100), (2, 1 << 12, 90), (3, 64, 100), (3, 1 << 20, 100), (4, 1 << 12, 70)])
def test_phrases_equal_brute_force(spark, shards, slots, share):
    rows = phrase_rows(shards)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("shard", "p", "n", "codes", "word", "since")})
    got = collocations.mine(docs.repartition(4), least=9, share=share, shards=shards, slots=slots)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == mined_by_hand(rows, 9, share)


def test_words_that_share_a_hash_are_hashed_again(spark):
    rows = [("en", "a b c " * 20)]
    first = lambda word, seed: collocations.word_hash(word, seed) if seed else 12345
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), least=5, hashed=first)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == mined_by_hand(rows, 5, 100)


def test_phrases_of_odd_rows(spark, odd, none):  # noqa: F811
    own = odd.withColumn("n", F.lit(1))
    got = collocations.best(collocations.mine(own, least=3), 4).collect()
    want = mined_by_hand([(r[3], r[1]) for r in odd_rows()], 3, 100)
    for lang in {w[0] for w in want}:
        first = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))[:4]
        assert [(r.phrase, r.a, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.lang == lang] == [(w[1], w[2], w[6]) for w in first]
    assert collocations.mine(none).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**15
    df = spark.createDataFrame([(big, 3 * big, big, big + 1)], "a long, n long, l long, r long")
    assert df.select(collocations._score("a", "n", "l", "r")).first()[0] == 1000 * big * 3 * big // (big * (big + 1))


def test_phrases_of_all_scans_are_read_as_one_table(spark):
    """The plan of a scan, which the driver holds, doesn't grow with the scans before it."""
    coded = collocations._coded(spark.createDataFrame([("en", "a b c d e f. a b c d e f")] * 9, "lang string, text string"), 3, 0, collocations.word_hash)
    found, scans = collocations.count_phrases(coded, 3, 9, slots=1 << 12)
    assert scans > 5 and found.count() == 20
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_driver_gets_a_bitmap_as_columns(spark):
    hashes = spark.range(1 << 18).select(F.xxhash64("id").alias("h"))
    tracemalloc.start()
    bits = common.bitmap(hashes, 1 << 22)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = np.zeros(1 << 22, bool)
    expected[hashes.toPandas()["h"].to_numpy() % (1 << 22)] = True
    assert np.array_equal(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool), expected)
    assert most < 8 << 20  # as rows: some 20 MB
