"""Fingerprints that add up, importance resampling and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from ledgerloom.llm import importance, manifest, multiset_hash, queries
from ledgerloom.llm.common import Hashed

from ..conftest import SMALL
from .test_dedup_and_rules import ODD, table

# -- fingerprints


def plain_vector(text):
    """The vector of a text, lane by lane in Python integers."""
    mask, lanes = (1 << 64) - 1, [0] * multiset_hash.LANES

    def mixed(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & mask
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 33

    own = Hashed()
    for line in (text or "").encode().split(b"\n"):
        digest = hashlib.shake_128(line).digest(4 * multiset_hash.EXACT)
        for i in range(multiset_hash.EXACT):
            lanes[i] += int.from_bytes(digest[4 * i : 4 * i + 4], "little")
        words = line.lower().split()
        n = min(5, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            h = n
            for w in words[k : k + n]:
                h = (h * 0x9E3779B97F4A7C15 + own[w]) & mask
            h = mixed(h)
            lanes[multiset_hash.EXACT + h % multiset_hash.LIKE] += 1 if h >> 63 else -1
    return [x % (1 << 32) for x in lanes]


def plain_neighbours(rows):
    """(doc_id, text) of different ids to the contract's row."""
    rows = sorted((i, t or "") for i, t in rows)
    out, own = {}, Hashed()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 2
        new = t[: len(t) - cut] + after[:cut]
        v, w, x = (multiset_hash.vector_of(s, own) for s in (t, new, after))
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), multiset_hash.written(v), multiset_hash.written(w), multiset_hash.likeness(v, w), multiset_hash.likeness(v, x))
    return out


def test_vectors_as_brute_force():
    own = Hashed()
    texts = [*ODD[:5], *ODD[7:], "a b c d e f\na b c\n\nA b c\na b c d e f", "\n", "x\ny", "yes " * 300]
    for t in texts:
        assert multiset_hash.vector_of(t, own).tolist() == plain_vector(t)
        assert multiset_hash.read(multiset_hash.written(multiset_hash.vector_of(t, own))).tolist() == plain_vector(t)


def test_order_does_not_matter_and_paragraphs_come_and_go():
    own, rng = Hashed(), random.Random(4)
    lines = [f"line {i} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(9)) for i in range(40)] + ["", "same", "same"]
    of = lambda ls: multiset_hash.vector_of("\n".join(ls), own)
    mixed = rng.sample(lines, len(lines))
    assert (of(lines) == of(mixed)).all() and multiset_hash.likeness(of(lines), of(mixed)) == 1.0
    assert (of(lines) - of([lines[3]]) == of(lines[:3] + lines[4:])).all()
    assert (of(lines) + of(["new"]) == of([*lines, "new"])).all()
    assert not (of(lines) == of(lines[:-1])).all() and not (of(["a", "b"]) == of(["a b"])).all()
    assert (multiset_hash.vector_of("x\n" * 9000, own) == of(["x"]) * np.uint32(9000) + of([""])).all()  # past AT_ONCE
    half = multiset_hash.likeness(of(lines), of(lines[:20] + [f"other {i} words than before here" for i in range(20)]))
    assert 0.35 < half < 0.75


def test_neighbours_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op11_fingerprints"](spark, SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_neighbours(rows) and len(got) == len(rows)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.3
    same = {}
    for (_, t), r in zip(sorted(rows), sorted(got), strict=True):
        assert same.setdefault(t, r.fingerprint) == r.fingerprint


def test_neighbours_of_odd_rows(spark, monkeypatch):
    """Null ids, repeated ids and rows, many ranges for few rows, one row, none."""
    monkeypatch.setattr(multiset_hash, "TASK_BYTES", 1 << 12)
    got = multiset_hash.neighbours(table(spark, ODD)).collect()
    assert len(got) == len(ODD) + 3
    texts = [t or "" for t in ODD]
    for r in got:
        if r.doc_id is None:
            assert (r.n_chars, r.near_next) == (12, None) and r.edited_sha256 == hashlib.sha256(b"null i").hexdigest()
            continue
        t, after = texts[r.doc_id], {texts[(r.doc_id + 1) % len(texts)]} | ({texts[r.doc_id]} if r.doc_id in (1, 3) else set())
        cut = len(t) // 2
        assert r.edited_sha256 in {hashlib.sha256((t[: len(t) - cut] + a[:cut]).encode()).hexdigest() for a in after}
    docs = spark.createDataFrame([(i % 3, f"text {i} of {i % 3}") for i in range(60)], "doc_id long, text string").repartition(5)
    got = multiset_hash.neighbours(docs).collect()
    assert len(got) == 60 and len({r.fingerprint for r in got}) == 60
    one = multiset_hash.neighbours(spark.createDataFrame([(5, "a b")], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(5, 1.0, hashlib.sha256(b"a a").hexdigest())]
    assert multiset_hash.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert multiset_hash.neighbours(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).count() == 2


def test_sums_and_edits_on_spark(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "b\nc d"), (3, None), (None, "z")], "doc_id long, text string")
    known = multiset_hash.fingerprints(docs)
    own = Hashed()
    fp = lambda t: multiset_hash.written(multiset_hash.vector_of(t, own))
    assert {r.doc_id: r.fingerprint for r in known.collect()} == {1: fp("a\nb"), 2: fp("b\nc d"), 3: fp(""), None: fp("z")}
    edits = spark.createDataFrame([(1, "a", -1), (1, "new one", 1), (1, "b", 1), (3, "", -1), (3, "q", 1), (9, "fresh", 1)], "doc_id long, paragraph string, sign int")
    got = {r.doc_id: r.fingerprint for r in multiset_hash.edited(known, edits).collect()}
    assert got == {1: fp("b\nb\nnew one"), 2: fp("c d\nb"), 3: fp("q"), 9: fp("fresh"), None: fp("z")}
    from pyspark.sql import functions as F

    total = multiset_hash.summed(known.select("fingerprint", F.lit(1).alias("sign"))).collect()
    assert [r.fingerprint for r in total] == [fp("a\nb\nb\nc d\n\nz")]
    assert multiset_hash.summed(known.limit(0).select("fingerprint", F.lit(1).alias("sign"))).count() == 0


# -- importance resampling


def plain_resample(docs, target, percent=25, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    buckets = lambda w: [zlib.crc32(f.encode()) % 10000 for f in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in buckets(words(text)):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        w = words(text)
        own = buckets(w)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resample_as_brute_force(spark):
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    long = [f"{t or ''} Word{i} É2 " * 12 for i, t in enumerate(ODD[3:5] * 6)]
    texts = [*ODD, *long, "the\x00of-the 3 Ω", *target[:3]]
    rows = [*enumerate(texts), (1, texts[1]), (3, texts[3]), (None, "null id here")]
    got = importance.resample(table(spark, texts), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target)
    twice = [(i, "many words of one kind " * 6) for i in (4, 4, 2, 9, None, None, None)]
    docs = spark.createDataFrame(twice, "doc_id int, text string")
    assert sorted(map(tuple, importance.resample(docs, bench, percent=60).collect()), key=repr) == plain_resample(twice, target, 60)
    assert importance.resample(docs.limit(0), bench).count() == 0
    assert sorted(map(tuple, importance.resample(docs, bench.limit(0)).collect()), key=repr) == plain_resample(twice, [])


def test_hot_bucket_and_very_long_text(spark):
    """One word makes up most features, one document most words."""
    docs = [(i, "same " * (60_000 if i == 0 else 30) + f"own{i}") for i in range(40)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "same same other")], "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, ["same same other"])


# -- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def plain_manifest(rows):
    """Rows of documents (all five columns) to the contract's rows."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(part, r))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([leaf(r) for r in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    top = plain_levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = []
            for levels, at in ((trees[s], i), (top, k)):
                for nodes in levels[:-1]:
                    low = at // 3 * 3
                    steps.append((nodes[low:at], nodes[at + 1 : low + 3]))
                    at //= 3
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = (*r[:4], r[4].replace("\n", ""))
            own = leaf(now)
            for left, right in steps:
                own = sha(*left, own, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*[x for a, b in steps for x in (*a, *b)]), own, own == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_manifest_as_brute_force(spark):
    """Sources of one leaf, of just a block, and of more; nulls, repeats, columns called as the operator's own."""
    rng = random.Random(8)
    rows = [(i, "big", rng.choice(["en", None, ""]), rng.choice([None, i]), f"t{i}\nend" if i % 3 else f"t{i}") for i in range(2 * manifest.BLOCK + 5)]
    rows += [(100_000 + i, "block", "de", 1, "x\n") for i in range(manifest.BLOCK)]
    rows += [(i, s, None, None, t) for i, s, t in [(1, None, None), (2, "", "a\n"), (3, "é", "\n"), (4, "Z", "\x00"), (None, "Z", "n\n"), (None, None, "n\n"), (2, "", "a\n"), (2, "", "b"), (7, "z" * 300, "é " * 50_000)]]
    docs = spark.createDataFrame([(*r, "c", 5, 6) for r in rows], f"{SCHEMA}, tree string, block long, leaf int").repartition(7)
    got = manifest.verified(docs, *manifest.without_line_breaks())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == plain_manifest(rows)


def test_manifest_of_many_sources_and_of_nothing(spark):
    rows = [(i, f"s{i % 5000}", "en", 1, "a") for i in range(6000)]
    assert rows_of(manifest.verified(spark.createDataFrame(rows, SCHEMA), *manifest.without_line_breaks())) == plain_manifest(rows)
    one = [(1, "s", "en", 1, "a\nb")]
    got = rows_of(manifest.verified(spark.createDataFrame(one, SCHEMA)))
    assert [r[1] == r[2] == r[3] == r[5] and r[4] == sha("") and r[6] for r in got] == [True]
    assert manifest.verified(spark.createDataFrame([], SCHEMA), *manifest.without_line_breaks()).count() == 0
