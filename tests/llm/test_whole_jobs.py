"""Corpus operators past the sizes, depths and thresholds that the given tables have."""

import math
import re

import numpy as np

from ledgerloom.llm import decontaminate, near_dedup, quality_rules, secret_scan, url_filter
from ledgerloom.llm.common import save


def test_bands_follow_the_threshold():
    """Of 3,000 pairs of 0.80, bands of 8 miss some 8; those for 0.80 miss none."""
    assert near_dedup.band_rows(85) == 8
    rng, borrow, rows = np.random.default_rng(5), near_dedup._borrow_table(), near_dedup.band_rows(80)
    missed = 0
    for _ in range(3000):
        own = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        a, b = (near_dedup.signature(np.sort(x), borrow) for x in (own[:900], own[100:]))  # 800 of 1,000
        missed += not (near_dedup.band_hashes(a, rows) == near_dedup.band_hashes(b, rows)).any()
    assert missed == 0


def test_ranks_settle_on_a_long_chain(spark):
    """A chain of 30 hosts with a way back, against the solved ranks; every host is reached."""
    n, d = 30, url_filter.DAMPING
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(n - 1)] + [(f"h{n - 1}", "h0", 1)]
    got = {r.host: r["rank"] for r in url_filter.propagated(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([("h0", 1.0)], "host string, seed double")).collect()}
    move = np.roll(np.eye(n), 1, axis=0)
    want = np.linalg.solve(np.eye(n) - d * move, (1 - d) * np.eye(n)[0])
    assert max(abs(got.get(f"h{i}", 0) - want[i]) for i in range(n)) < 1e-5


def test_each_labelled_language_has_its_own_cutoff(spark):
    """1,100 labelled languages and null ones with a cutoff: it decides on null languages only."""
    bucketed = lambda i, lang, bad: (i, lang, (50 if bad else 0, False))
    rows = [bucketed(i, None, i % 2) for i in range(6000)] + [bucketed(10_000 + i, f"l{i}", 1) for i in range(1100)] + [bucketed(20_000, "unlabelled", 1), bucketed(20_001, None, 1)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, rules struct<bucket:int,base_failed:boolean>")
    labels = spark.createDataFrame([(i, 0 if i < 6000 and i % 2 else 1) for i in [*range(6000), *range(10_000, 11_100)]], "doc_id long, quality int")
    cutoffs = {r.stratum: r.cutoff for r in quality_rules.learnt(measured, labels).collect()}
    assert len(cutoffs) == 1101 and cutoffs["*"] is not None
    kept = {r.doc_id: r.kept for r in quality_rules.judge(measured, labels).collect()}
    assert kept[20_000] and not kept[20_001] and all(kept[10_000 + i] for i in range(1100))


def test_keys_in_mixed_runs_are_tested(spark):
    """Random keys behind a path or prefix that mixes + or / with - or _."""
    rng = np.random.default_rng(3)
    key = lambda more: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more), 90))
    keys = [key(more) for more in ["", "+/", "-_"] * 8]
    texts = [("at /user-files/", "sk_live/", "at my-own/")[i % 3] + k for i, k in enumerate(keys)]
    docs = spark.createDataFrame([*enumerate(texts), (100, "so internal/pages-of/the_longest/documentation-folder it is")], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in secret_scan.report(docs).collect()}
    found = [any(s.startswith("random:") and s.endswith(f":{len(t)}") for s in got[i]) for i, t in enumerate(texts)]
    assert sum(found) >= 20 and got[100] == [""]
    assert sum("[SECRET]" in r.text and keys[r.doc_id] not in r.text for r in secret_scan.redact(docs.where("doc_id < 100")).collect()) >= 20


def battery(token):
    """(random by the smallest of three p-values, that p, stratum, step) of one token, straight from the formulas."""
    abc = next(letters for _, pattern, letters in secret_scan.ENCODINGS if re.fullmatch(pattern, token))
    n, k, upper = len(token), len(abc), lambda z: math.erfc(z / math.sqrt(2)) / 2
    same = sum(token.count(ch) ** 2 for ch in abc)
    spread = 2 / (9 * (k - 1))
    chi = (max(k / n * same - n, 0) / (k - 1)) ** (1 / 3) - (1 - spread)
    at = [abc.index(ch) + 1 for ch in token]
    high = [a > k / 2 for a in at]
    up, mean = sum(high), sum(at) / n
    expected = 2 * up * (n - up) / n + 1
    runs = abs(1 + sum(a != b for a, b in zip(high, high[1:])) - expected) / math.sqrt(max(expected - 1, 1e-9) * max(expected - 2, 1e-9) / (n - 1))
    lag, var = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:])), sum((a - mean) ** 2 for a in at)
    serial = abs(lag / max(var, 1e-9) + 1 / n) * math.sqrt(n)
    least = min(upper(chi / math.sqrt(spread)), 2 * upper(runs), 2 * upper(serial))
    s2, s3 = secret_scan.ORDINARY
    z = -((same - n) / 2 - n * (n - 1) / 2 * s2) / math.sqrt(n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2))
    ln_p = math.log(upper(z)) + (n * math.log(secret_scan.HEX_SHARE) if k == 16 else 0)
    return 3 * least >= secret_scan.LEAST_P, 3 * least, min(secret_scan.TOP_STRATUM, int(math.log2(n / secret_scan.LEAST_LENGTH))), min(secret_scan.MOST_STEPS, int(max(-ln_p, 0)))


def test_battery_and_discovery_rate_as_brute_force(spark):
    rng = np.random.default_rng(11)
    draw = lambda abc, n: "".join(rng.choice(list(abc), n))
    tokens = [draw(abc, int(n)) for _, _, abc in secret_scan.ENCODINGS for n in (20, 24, 31, 40, 64, 90, 200, 700)] * 2
    tokens += ["a" * 30, "ab" * 40, "internationalisationandlocalisation", "0123456789abcdef" * 4, "thequickbrownfoxjumpsoverthelazydog" * 3]
    scanned = save(secret_scan.scan(spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")), "scanned")
    got = {r.doc_id: r.found.tokens for r in scanned.collect()}
    told = []
    for i, token in enumerate(tokens):
        (own,) = got[i]
        random, p, stratum, step = battery(token)
        assert (own.start, own.end, own.stratum) == (0, len(token), stratum) and abs(own.step - step) <= 1 + step // 50
        assert own.random == random or 0.8 < p / secret_scan.LEAST_P < 1.25  # the tail is within a few per cent
        told.append((own.stratum, own.step, own.random))
    want = {}
    for stratum in {s for s, _, _ in told}:
        steps = [(step, random) for s, step, random in told if s == stratum]
        fits = [x for x in {x for x, _ in steps} if 0 < (above := sum(r for y, r in steps if y >= x)) and math.exp(-x) <= secret_scan.FDR * above / len(steps)]
        if fits:
            want[stratum] = min(fits)
    assert secret_scan.thresholds(scanned) == want


def test_recall_by_encoding_and_length(spark):
    """Shares of random keys found among ordinary words; README gives the same figures."""
    rng = np.random.default_rng(12)
    rows, kinds = [], [("hex", "0123456789abcdef"), ("base32", secret_scan.ENCODINGS[2][2]), ("base62", secret_scan.ENCODINGS[4][2]), ("base64", secret_scan.ENCODINGS[5][2])]
    for name, abc in kinds:
        for n in (24, 40, 64, 90, 128):
            rows += [(name, n, f"the key {''.join(rng.choice(list(abc), n))} is here") for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: "random:" in r.spans or "hex:" in r.spans for r in secret_scan.report(docs).collect()}
    share = {(name, n): sum(found[i] for i, (a, b, _) in enumerate(rows) if (a, b) == (name, n)) / 60 for name, _ in kinds for n in (24, 40, 64, 90, 128)}
    print(share)
    assert all(share[name, n] >= 0.9 for name, _ in kinds for n in (90, 128)) and share["hex", 40] == 1


def outputs(fields):
    """The fields of a projection, from its text behind the opening bracket."""
    out, depth = [""], 0
    for ch in fields:
        depth += (ch in "([") - (ch in ")]")
        if depth < 0:
            break
        out = [*out, ""] if ch == "," and not depth else [*out[:-1], out[-1] + ch]
    return [f.strip() for f in out]


def test_decontamination_shuffles_no_whole_text(spark, monkeypatch):
    """Nothing broadcast: the same rows, and no exchange of positions carries the words of a document."""
    from ..conftest import SMALL
    from .test_dedup_and_rules import leaks

    plans, kept = {}, decontaminate.save

    def watched(df, label, **more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return kept(df, label, **more)

    monkeypatch.setattr(decontaminate, "save", watched)
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST_SHINGLES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = leaks([(r.doc_id, r.text) for r in docs.collect()], items)
    assert {i: (x[1], x[2], x[4]) for i, x in want.items()} == got
    for label in ("held", "matches"):
        below = [b.split("Project [", 1)[1] for a, b in zip(plans[label], plans[label][1:]) if "Exchange hashpartitioning(key" in a and "Project [" in b]
        assert below and not any(f.startswith("w#") for b in below for f in outputs(b))
        assert not any("Filter (size(array_remove(split(" in x for x in plans[label])  # each text is split once


def test_a_word_shared_by_many_items_and_found_often(spark, monkeypatch):
    """1,000 items of one word, found 10,000 times in a document: no step makes a row for each pair."""
    seen = {}
    real = decontaminate.save

    def counting(df, label, keep=False):
        out = real(df, label, keep)
        seen[label] = max(seen.get(label, 0), out.count())
        return out

    monkeypatch.setattr(decontaminate, "save", counting)
    docs = spark.createDataFrame([(1, "yes " * 10_000), (2, "no Yes no"), (3, "no")], "doc_id int, text string")
    items = spark.createDataFrame([*[(i, "Yes") for i in range(1000)], (2000, "no yes no")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (10_000, 10_000, 1000, True), 2: (3, 3, 1001, True), 3: (1, 0, 0, False)}
    assert seen["placed"] == 3 and max(seen.values()) <= 10_002


def test_windows_over_the_ends_of_blocks(spark):
    """Windows that begin anywhere in a text of several blocks, at its very end too."""
    words = [f"w{i}" for i in range(3 * decontaminate.BLOCK + 17)]
    starts = [0, 1, 55, 60, 63, 64, 65, 120, 127, 128, 191, len(words) - 10]
    items = spark.createDataFrame([(s, " ".join(words[s : s + 10])) for s in starts], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:70])), (3, " ".join(words[60:73]))], "doc_id long, text string")
    got = {r.doc_id: (sorted(r["items"], key=int), sorted(s.start for s in r.spans)) for r in decontaminate.hits(docs, items).collect()}
    fit = lambda a, b: [s for s in starts if a <= s and s + 10 <= b]
    assert got == {d: ([str(s) for s in fit(a, b)], [s - a for s in fit(a, b)]) for d, a, b in ((1, 0, len(words)), (2, 0, 70), (3, 60, 73))}
