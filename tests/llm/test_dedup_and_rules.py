"""Near-dedup, decontamination, quality rules, secrets: against brute force, and at the edges."""

import collections
import hashlib
import pathlib
import re

import numpy as np
import pytest

from ledgerloom.llm import decontaminate, near_dedup, quality_rules, secret_scan
from ledgerloom.llm.common import Hashed, save, scratch, scratch_root, shingles

from ..conftest import SMALL

ODD = [None, "", "  \n\t", "one", "One two", "x" * 50_000, "é " * 3000, "\x00\x1f", "a\r\nb\r\n", "🙂 " * 40]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, rules int, found string, spans int, key int, w int, _t int"


def table(spark, texts, schema=SCHEMA):
    """Documents with extra columns whose names the operators use themselves; ids and texts repeat."""
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, 7, "b", 1, "f", 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1], rows[3], (None, "null id here", *rows[0][2:])], schema)


def sets(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def components(own, percent=85):
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if b < a and own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = sets([(r.doc_id, r.text) for r in docs.collect()])
    want = components(own)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(own[i]), c, c == i) for i, c in want.items()}


def test_near_duplicates_chain_and_cluster(spark):
    """A chain whose ends are unlike, and a cluster whose members are like its centre but often not each other."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(words, 220))
    texts = []
    chain = list(base)
    for k in range(12):
        texts.append(" ".join(chain))
        chain[k * 15 : k * 15 + 1] = [f"new{k}", f"more{k}"]
    centre = list(rng.choice(words, 300))
    for k in range(60):
        own = list(centre)
        for at in rng.choice(300, 4, replace=False):
            own[at] = f"z{k}{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(sets(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == want


def family(rng, size, changed):
    """Texts that differ from one of 300 words in ``changed`` places each."""
    centre = [f"w{i}" for i in rng.choice(4000, 300)]
    out = []
    for k in range(size):
        own = list(centre)
        for at in rng.choice(300, changed, replace=False):
            own[at] = f"z{k}{at}"
        out.append(" ".join(own))
    return out


def test_unlike_members_of_buckets_send_no_sets(spark, monkeypatch):
    """Texts that share buckets but are far from alike are ruled out by signatures, before their sets are made; tables that are done with are gone by then."""
    texts = family(np.random.default_rng(6), 60, 8)
    asked, there, full_sets = [], [], near_dedup.full_sets

    def counted(docs, ids, wanted=None):
        asked.append(ids.count())
        there.append({p.name.split("-")[0] for p in pathlib.Path(scratch_root(spark).removeprefix("file://")).iterdir()})
        return full_sets(docs, ids, wanted)

    monkeypatch.setattr(near_dedup, "full_sets", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and len(got) == 60
    assert asked[0] > 0 and asked[1:] == [0]
    assert "nodes" in there[1] and not {"sketches", "sets", "pairs"} & there[1]


def test_ids_that_repeat_without_words(spark):
    """A blank row that repeats an id changes nothing for the row with words, in the block search either."""
    texts = family(np.random.default_rng(4), 60, 4)
    rows = [*enumerate(texts), *((i, " ") for i in range(60))]
    want = components(sets(enumerate(texts)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.n_shingles) == sorted(want.items())
    assert [(r.component_id, r.kept) for r in got if not r.n_shingles and r.doc_id == 5] == [(5, True)]


def test_repeated_ids_are_one_document(spark):
    """A doc_id with several texts links the documents that are like either."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (7, a), (7, b), (9, b), (11, "alone in this"), (11, "alone in this"), (12, "alone in this"), (3, ""), (3, b + " more")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 56): (3, False), (7, 56): (3, False), (9, 56): (3, False), (11, 1): (11, True), (12, 1): (11, False), (3, 0): (3, True), (3, 57): (3, True)}


def test_repeated_ids_as_brute_force(spark):
    """Random families of texts over random ids; each id may have several."""
    rng = np.random.default_rng(8)
    centres = [list(rng.choice([f"w{i}" for i in range(900)], 90)) for _ in range(6)]
    rows = []
    for _ in range(140):
        own = list(centres[rng.integers(6)])
        for at in rng.choice(90, rng.integers(0, 4), replace=False):
            own[at] = f"n{rng.integers(40)}"
        rows.append((int(rng.integers(110)), " ".join(own)))
    own = sets(enumerate(t for _, t in rows))
    linked = components(own)  # of rows
    least = {}
    for i in range(len(rows)):  # rows of an id are linked too: take the least id until nothing changes
        least[i] = rows[i][0]
    while True:
        by_class, by_id = {}, {}
        for i, (d, _) in enumerate(rows):
            by_class[linked[i]] = min(by_class.get(linked[i], 1 << 30), least[i])
            by_id[d] = min(by_id.get(d, 1 << 30), least[i])
        new = {i: min(by_class[linked[i]], by_id[d]) for i, (d, _) in enumerate(rows)}
        if new == least:
            break
        least = new
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, least[i]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_edges(spark):
    got = near_dedup.near_duplicates(table(spark, ODD)).collect()
    assert len(got) == len(ODD) + 3
    blank = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in blank)
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, True, 1)]
    empty = near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_densification_fills_every_bin():
    borrow = near_dedup._borrow_table()
    for text in ("one", "a b c d e f", "w " * 2000):
        h = shingles(text, Hashed())
        assert set(near_dedup.signature(h, borrow).tolist()) <= set(h.tolist())


def test_signatures_estimate_similarity():
    borrow, hashed = near_dedup._borrow_table(), Hashed()
    words = [f"w{i}" for i in range(1000)]
    a, b = shingles(" ".join(words), hashed), shingles(" ".join(words[60:]), hashed)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (near_dedup.signature(a, borrow) == near_dedup.signature(b, borrow)).mean()
    assert abs(same - true) < 0.1


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(texts, items):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            if n and i is not None:
                wins[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in texts:
        w = item_words(t)
        hit, own = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_as_brute_force(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(docs, items).collect()}
    assert got == want and any(w[4] for w in want.values())


def test_contamination_edges(spark):
    long = " ".join(f"k{i}" for i in range(14))
    items = [(1, "Two words"), (2, long), (2, None), (3, "!!"), (None, "null id here"), (4, "É è É"), (5, "two WORDS")]
    texts = [*ODD, f"x {long.upper()} y", long[:-4], "two-words two words, two", "É è É è é È", "é è é"]
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect() if r[0] is not None}
    assert got == leaks(list(enumerate(texts)), items)
    none = decontaminate.contamination(table(spark, ODD), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(ODD) + 3 and none.where("contaminated").count() == 0
    assert decontaminate.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_as_brute_force(spark):
    texts = [*ODD, "a b c a b c a b", "x y\nx y\n\nx y", "# $ | <b>", *[r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(80).collect()]]
    got = {r.doc_id: r["q"] for r in quality_rules.measure(table(spark, texts), into="q").collect()}
    for i, t in enumerate(texts):
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == counts(t)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)


def test_repeated_words_where_windows_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_WINDOW_HASH", "cast(length(get(_w, i)) as bigint)")
    texts = ["a b c d a b c x y z a b c", "a b c d e f", "q w e r t y q w e", "a a a a", *[r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.rules.n_repeat_words for r in quality_rules.measure(docs).collect()} == {i: counts(t)[4] for i, t in enumerate(texts)}


def test_odd_languages(spark):
    """Null languages, one called as the stratum of null ones is, columns called as the operator's own."""
    rows = [(i, ("*", None, "de")[i % 3], 1, 2, (50 if i % 2 else 0, False)) for i in range(3000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, stratum int, cutoff int, rules struct<bucket:int,base_failed:boolean>")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(3000) if i % 3 != 0], "doc_id long, quality int")
    judged = quality_rules.judge(measured, labels)
    assert judged.columns == [*measured.columns, "kept"]
    assert {r.doc_id: r.kept for r in judged.collect()} == {i: i % 2 == 0 or i % 3 == 0 for i in range(3000)}  # "*" has no labels


def test_cutoffs_bound_false_rejection(spark):
    """With enough good documents a cutoff between good and bad is certified; with few, none is."""
    fine = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"word{i}$$$%%%" for i in range(80))
    rows = [(i, fine if i % 10 else noisy, "en") for i in range(1500)] + [(5000 + i, fine if i % 10 else noisy, "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(t == fine), 0) for i, t, _ in rows], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r.kept for r in quality_rules.judge(save(quality_rules.measure(docs), "m"), labels).collect()}
    assert all(judged[i] == (t == fine) for i, t, g in rows if g == "en")
    assert all(judged[i] for i, _, g in rows if g == "de")
    none = quality_rules.judge(save(quality_rules.measure(docs), "m"), labels.limit(0))
    assert none.where("kept").count() == len(rows)


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    t = t or ""
    s = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    s += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [sum(x[1] == k for x in s) for k in range(3)], ",".join(x[2] for x in sorted(s))


def test_base_secrets_as_brute_force(spark):
    texts = [*ODD, "🙂 password: 'abcdefgh' token=short token:token:abcdefghij", "API_KEY = AKIA" + "B" * 16, "k " + "0" * 40 + "\nAKIA" + "A" * 11, "secret=" * 30, "PASSWD\"  =  \"x.y-z_9+/=aa", *[r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]]
    got = {r.doc_id: r for r in secret_scan.report(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, spans = base(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == n
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == [s for s in spans.split(",") if s]


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = np.random.default_rng(9)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    token = lambda n: "".join(rng.choice(letters, n))
    plain = ["internationalisierungsmassnahmenkatalog", "thethethethethethethethethethethe", "a-very-long-hyphenated-compound-word-here", "ANOTHERLONGSHOUTEDSENTENCEWITHOUTSPACES"]
    docs = spark.createDataFrame([(i, f"see {token(90)} end") for i in range(20)] + [(100 + i, f"so {t} it is") for i, t in enumerate(plain)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.report(docs).collect()}
    assert sum(got[i] == "random:4:94" for i in range(20)) >= 18
    assert all(got[100 + i] == "" for i in range(len(plain)))


def test_redaction(spark):
    docs = table(spark, [None, "", "clean text", "a password=hunter2hunter2 b " + "f" * 40 + " c"])
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == "clean text" and got[3] == "a [SECRET] b [SECRET] c"


def test_scratch_is_deleted(spark):
    import os

    here = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(here))
    with scratch(spark):
        save(spark.range(3), "x")
        assert len(set(os.listdir(here)) - before) == 1
    assert set(os.listdir(here)) == before


@pytest.mark.parametrize("make", [lambda d: secret_scan.report(d), lambda d: secret_scan.redact(d), lambda d: quality_rules.measure(d)])
def test_empty_tables(spark, make):
    assert make(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
