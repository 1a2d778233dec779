"""Exact duplicates, resampling and collocations against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sulatan.llm import collocations, exact_dedup, importance, quotient
from sulatan.llm.words import mix

SCHEMA = "doc_id long, text string, lang string, key string, row long, ids long, n long, rank string"


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _texts():
    rng = random.Random(11)
    vocab = ["new", "york", "City", "the", "of", "a.", "b,", "É", "é", "漢字", "x\ty", "i", "1st", "long" * 20]
    rows = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows += ["New York City is new york city"] * 9 + ["new york CITY is new york city"] * 4 + ["red\nred. red; red"] * 5
    return rows + ["", " ", "\t\n", "ABC", "abc", "ÀBC", "àbc", "Ab c", "ab  c", "of the " * 4000]


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "de", None, "und"]
    own = [(i, t, langs[i % 4]) for i, t in enumerate(_texts())]
    return own + [(None, "no id", "en"), (None, "No ID", "en"), (900, None, None), (3, own[3][1], "en"), (3, own[3][1], "en"), (5, "another text", "en"), (-4, "abc", "de")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, 8, 9, "z") for r in rows], SCHEMA).repartition(7).cache()


# --- exact duplicates --------------------------------------------------------------

def _exact(rows, keep):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[_lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known, default=None)
        left = ids.count(best)
        for i in ids:
            out.append((i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()))
        assert left
    return sorted(out, key=str), len(groups)


def _weak(text):
    return F.concat(F.lit("h"), F.octet_length(text).cast("string")).cast("binary")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, _weak])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_exact_groups(docs, rows, keep, hashed, most):
    """A hash of the length alone collides at every turn; the groups stay right."""
    got = exact_dedup.exact_groups(docs, keep=keep, hashed=hashed, broadcast_groups=most).collect()
    want, n_groups = _exact(rows, keep)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(kept) == n_groups and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_edges(spark, docs, rows):
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs, keep="first")
    out = exact_dedup.distinct_rows(docs)
    assert out.columns == docs.columns and out.count() == _exact(rows, "largest")[1]
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.exact_groups(many).where("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1334, 3999, 1)


# --- resampling ------------------------------------------------------------------------

def _features(text):
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", _lower(text)) if w]
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _resampled(rows, target, share, least):
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x, _ in rows for f in _features(x)[1]), Counter(bucket(f) for x in target for f in _features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))
    out = []
    for doc_id, text, _ in rows:
        words, feats = _features(text)
        weight = sum(gain(bucket(f)) for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = Counter()
    for k, r in enumerate(able[: share * len(able) // 100]):
        rank[r[:4] + (k + 1,)] += 1
    return out, rank


def test_resample(spark, docs, rows, monkeypatch):
    target = ["The city of New York.", "the of the", None, "", "new york"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for piece in (1 << 20, 64):
        monkeypatch.setattr(importance, "PIECE", piece)
        got = importance.resample(docs, wanted, share=50, least_words=5).collect()
        all_rows, rank = _resampled(rows, target, 50, 5)
        assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in all_rows)
        assert Counter(tuple(r) for r in got if r["rank"]) == rank
    assert importance.resample(docs.limit(0), wanted).collect() == []
    none = importance.resample(docs, wanted.limit(0), share=0).collect()
    assert len(none) == len(rows) and not any(r["rank"] for r in none)


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_spans_of_runs(longest):
    line = importance.collapsed("One  two--three\n4 five; É six é")
    words = line.decode().split(" ")
    want = sorted(crc32(" ".join(words[i : i + k]).encode()) % 97 for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    for piece in (5, 1000):
        importance.PIECE, old = piece, importance.PIECE
        try:
            assert sorted(importance.feature_buckets(line, importance.run_pattern(longest), longest, 97)) == want
        finally:
            importance.PIECE = old
    assert len(importance.feature_buckets(b"", importance.run_pattern(longest), longest, 97)) == 0


# --- collocations ------------------------------------------------------------------------

def _phrases(rows, least, top, longest=3, share=50):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p for q, b in found.items() for n in range(2, len(q)) for i in range(len(q) - n + 1) if 100 * b >= share * found[p := q[i : i + n]]}
        best = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("held,piece,part", [(1 << 20, 1 << 20, 1 << 21), (50, 40, 64)])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations(docs, rows, monkeypatch, held, piece, part, longest):
    """Also with texts, filters and parts cut into very small ones."""
    for name, value in (("HELD", held), ("PIECE", piece), ("PART_ENTRIES", part)):
        monkeypatch.setattr(collocations, name, value)
    got = collocations.collocations(docs, least=3, top=15, longest=longest).collect()
    assert sorted(map(tuple, got)) == _phrases(rows, 3, 15, longest)


def test_collocations_edges(spark, docs, rows):
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs, least=10**6).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(docs, shortest=1)
    empty = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, ".;!", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(empty, least=1).collect() == []


def test_shared_ids_take_another_seed(docs, monkeypatch, rows):
    """Ids that clash are noticed over the whole vocabulary."""
    true = collocations._with_ids
    calls = []

    def clash(vocabulary, seed, width):
        calls.append(seed)
        out = true(vocabulary, seed, width)
        return out.withColumn("id", F.lit(5).cast("long")) if seed == 0 else out

    monkeypatch.setattr(collocations, "_with_ids", clash)
    assert sorted(map(tuple, collocations.collocations(docs, least=3, top=15).collect())) == _phrases(rows, 3, 15)
    assert calls == [0, 1]


def _keys(rng, n, width, size):
    ids = [rng.integers(0, 1 << min(width, 62), size).astype(np.uint64) for _ in range(n)]
    return [np.concatenate([x, x[: size // 3]]) for x in ids]


@pytest.mark.parametrize("n,width", [(2, 32), (2, 40), (3, 33), (3, 42), (3, 64), (4, 37)])
@pytest.mark.parametrize("part_bits", [0, 3])
def test_filters_give_keys_back(n, width, part_bits):
    rng = np.random.default_rng(n * width)
    ids, counts = _keys(rng, n, width, 500), rng.integers(1, 900, 666)
    limbs = quotient.permute(quotient.pack(ids, width))
    assert (quotient.unmix(mix(limbs[0])) == limbs[0]).all()
    want = Counter()
    for key, c in zip(zip(*(x.tolist() for x in ids)), counts.tolist()):
        want[key] += c
    got = Counter()
    cut = len(counts) // 2
    shards = [quotient.counted([x[part] for x in limbs], counts[part]) for part in (slice(0, cut), slice(cut, None))]
    for p in range(1 << part_bits):
        filters = []
        for keys, c in shards:
            edges = quotient.parts_of(keys, part_bits)
            raw = quotient.dump([x[edges[p] : edges[p + 1]] for x in keys], c[edges[p] : edges[p + 1]], part_bits, n * width)
            filters.append(quotient.load(raw, p, part_bits, n * width))
        keys, c = quotient.merge(filters)
        back = quotient.unpack(quotient.restore(keys), width, n)
        got.update(dict(zip(zip(*(x.tolist() for x in back)), c.tolist())))
    assert got == want


def test_equal_first_limbs_are_told_apart():
    limbs = [np.array([9, 9, 9, 9], np.uint64), np.array([2, 1, 2, 1], np.uint64)]
    keys, counts = quotient.counted(limbs, np.array([1, 10, 100, 1000]))
    assert keys[0].tolist() == [9, 9] and keys[1].tolist() == [1, 2] and counts.tolist() == [1010, 101]
