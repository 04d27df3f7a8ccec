"""Secret scan: fixed patterns, and a randomness test battery, in DataFrame functions only.

Base spans come from three patterns. The battery looks at long tokens besides them: a
token's encoding is inferred from its characters, and its symbols are tested for a
uniform alphabet (chi-squared), for runs about the middle of the alphabet and for serial
correlation. A random token passes all three. Whether an ordinary token would look as
uniform by chance depends on its length: the chi-squared statistic of symbols drawn as
in ordinary words has a known mean and variance for each length, which give a p-value.
A Benjamini-Hochberg step over all tokens of the corpus, by length stratum, bounds the
share of false finds; short tokens have little power and so are rarely found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_BROADCAST_ROWS, free_prefix, save, scratch, text_keys

#: Share of false finds that is allowed among the battery's finds.
FDR = 0.01
#: A token whose smallest of three randomness p-values, times three, is below this isn't random.
LEAST_P = 1e-3
#: Tokens of fewer characters aren't tested.
LEAST_LENGTH = 20
#: p-values are kept as whole multiples of -ln p, rounded down, up to this: a bounded table.
MOST_STEPS = 200
#: Matches whose starts are summed together: a text of n matches copies n * RUN references, not n * n.
RUN = 500
#: Tokens longer than this are tested in full, but share one length stratum.
TOP_STRATUM = 10

# The patterns of the base finds, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the battery tests: runs of base64 and base64url characters.
TOKEN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_LENGTH

#: Encodings in the order they are tried: name, what all characters must be, the alphabet in order.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("base36", "[a-z0-9]+", _DIGITS + _LOWER),
    ("base62", "[A-Za-z0-9]+", _DIGITS + _UPPER + _LOWER),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Sums over characters of the square and the cube of their shares in ordinary words.
ORDINARY = (0.065, 0.0062)
#: The share of ordinary characters that are hexadecimal digits too.
HEX_SHARE = 0.32



KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", TOKEN)]
_SPAN = "struct<start:int,end:int,kind:string>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tail(z: str) -> str:
    """ln of the upper tail of the normal distribution, within a few per cent of the tail for z > 0."""
    a = f"abs({z})"
    q = f"(ln((1 - exp(-1.4D * greatest({a}, 1e-9D))) / (1.135D * 2.5066282746D * greatest({a}, 1e-9D))) - {a} * {a} / 2)"
    return f"if({z} > 0, {q}, ln(1 - least(0.5D, exp({q}))))"


def _battery(t: str = "t") -> str:
    """SQL from one token (start, end, m) to start, end, stratum, step and whether it passes as random."""
    which = lambda pick: "case " + " ".join(f"when {{c}} rlike {_sql('^' + pattern + chr(92) + 'z')} then {pick(i)}" for i, (_, pattern, _) in enumerate(ENCODINGS)) + " else null end"
    letters = which(lambda i: _sql(ENCODINGS[i][2]))
    steps = [
        # (names, from the struct before as x)
        f"named_struct('start', x.start, 'end', x.end, 'c', rtrim('=', x.m), 'abc', {letters.format(c=f"rtrim('=', x.m)")})",
        "named_struct('start', x.start, 'end', x.end, 'n', cast(length(x.c) as double), 'k', cast(length(x.abc) as double), 'same', aggregate(split(x.abc, ''), 0D, (s, ch) -> s + power(cast(length(x.c) - length(replace(x.c, ch, '')) as double), 2D)), 'at', transform(filter(split(x.c, ''), ch -> ch <> ''), ch -> cast(instr(x.abc, ch) as double)))",
        "named_struct('start', x.start, 'end', x.end, 'n', x.n, 'k', x.k, 'same', x.same, 'at', x.at, 'mean', aggregate(x.at, 0D, (s, v) -> s + v) / x.n, 'up', aggregate(x.at, 0D, (s, v) -> s + if(v > x.k / 2, 1D, 0D)))",
        "named_struct('start', x.start, 'end', x.end, 'n', x.n, 'k', x.k, 'same', x.same, 'up', x.up, 'runs', 1D + aggregate(zip_with(slice(x.at, 1, size(x.at) - 1), slice(x.at, 2, size(x.at) - 1), (a, b) -> if((a > x.k / 2) <> (b > x.k / 2), 1D, 0D)), 0D, (s, v) -> s + v), 'lag', aggregate(zip_with(slice(x.at, 1, size(x.at) - 1), slice(x.at, 2, size(x.at) - 1), (a, b) -> (a - x.mean) * (b - x.mean)), 0D, (s, v) -> s + v), 'var', aggregate(x.at, 0D, (s, v) -> s + (v - x.mean) * (v - x.mean)))",
    ]
    s2, s3 = ORDINARY
    chi = "(pow(greatest(x.k / x.n * x.same - x.n, 0D) / (x.k - 1), 1D / 3) - (1 - 2 / (9 * (x.k - 1)))) / sqrt(2 / (9 * (x.k - 1)))"
    mean_runs = "(2 * x.up * (x.n - x.up) / x.n + 1)"
    runs = f"abs(x.runs - {mean_runs}) / sqrt(greatest({mean_runs} - 1, 1e-9D) * greatest({mean_runs} - 2, 1e-9D) / (x.n - 1))"
    serial = "abs(x.lag / greatest(x.var, 1e-9D) + 1 / x.n) * sqrt(x.n)"
    pairs = "(x.same - x.n) / 2"
    ordinary = f"(({pairs}) - x.n * (x.n - 1) / 2 * {s2}D) / sqrt(x.n * (x.n - 1) / 2 * {s2 - s2 * s2}D + x.n * (x.n - 1) * (x.n - 2) * {s3 - s2 * s2}D)"
    steps += [
        f"named_struct('start', x.start, 'end', x.end, 'n', x.n, 'k', x.k, 'chi', {chi}, 'runs', {runs}, 'serial', {serial}, 'ordinary', -({ordinary}))",
        f"named_struct('start', x.start, 'end', x.end, 'n', x.n, 'least', least({_tail('x.chi')}, ln(2D) + {_tail('x.runs')}, ln(2D) + {_tail('x.serial')}), 'ln_p', {_tail('x.ordinary')} + if(x.k = 16, x.n * ln({HEX_SHARE}D), 0D))",
        f"named_struct('start', x.start, 'end', x.end, 'stratum', cast(least({TOP_STRATUM}, floor(log2(x.n / {LEAST_LENGTH}))) as int), 'step', cast(least({MOST_STEPS}, floor(greatest(-x.ln_p, 0D))) as int), 'random', x.least + ln(3D) >= {math.log(LEAST_P)}D)",
    ]
    out = f"filter({t}, x -> length(rtrim('=', x.m)) >= {LEAST_LENGTH} and rtrim('=', x.m) rlike {_sql('^(?:' + '|'.join(p for _, p, _ in ENCODINGS) + ')' + chr(92) + 'z')})"
    for step in steps:
        out = f"transform({out}, x -> {step})"
    return out


def _parts(t: str) -> str:
    """SQL from tokens (start, end, m) to those that the battery tests.

    A run with both + or / and - or _ fits no encoding: its longest parts that fit base64 and
    those that fit base64url, which may overlap, take its place. Padding belongs to the last.
    """
    cells = f"transform({t}, x -> named_struct('x', x, 'ch', if(x.m rlike '[+/]' and x.m rlike '[_-]', filter(split(rtrim('=', x.m), ''), ch -> ch <> ''), cast(array() as array<string>))))"
    cuts = lambda seps: f"filter(transform(y.ch, (ch, i) -> if(ch in ({seps}), i, null)), i -> i is not null)"
    cut = f"transform({cells}, y -> named_struct('x', y.x, 'ch', y.ch, 'cuts', array({cuts("'-', '_'")}, {cuts("'+', '/'")})))"
    between = "zip_with(concat(array(-1), c), concat(c, array(size(y.ch))), (a, b) -> named_struct('a', a + 1, 'b', b))"
    part = "named_struct('start', y.x.start + p.a, 'end', if(p.b = size(y.ch), y.x.end, y.x.start + p.b), 'm', array_join(slice(y.ch, p.a + 1, p.b - p.a), ''))"
    return f"flatten(transform({cut}, y -> if(size(y.ch) = 0, array(y.x), transform(filter(flatten(transform(y.cuts, c -> {between})), p -> p.b - p.a >= {LEAST_LENGTH}), p -> {part}))))"


def scan(docs: DataFrame, into: str = "found") -> DataFrame:
    """``docs`` (text, any others) with one more struct column: base spans by kind, and tested tokens.

    Each pattern scans a text once more only where it has matches: the matches and what
    lies between them give the starts. Null text counts as empty.
    """
    own = [f"`{c}`" for c in docs.columns]
    p = free_prefix(docs)
    ours = lambda sql: re.sub(r"(?<![\w'])_(?=t\b|[mbszr]_)", p, sql)  # noqa: E731  _t, _m_hex and so on are columns of our own
    t = "coalesce(cast(text as string), '')"
    step = docs.selectExpr(*own, ours(f"{t} as _t"), *[f"regexp_extract_all({t}, {_sql(q)}, 0)" + ours(f" as _m_{k}") for k, q in KINDS])
    step = step.selectExpr("*", *[ours(f"if(size(_m_{k}) = 0, cast(array() as array<string>), split(_t, ") + _sql(q) + ours(f")) as _b_{k}") for k, q in KINDS])
    # Starts are running sums, taken in stretches of RUN matches: of the stretches first, then within each.
    pieces = "zip_with(_m_{k}, slice(_b_{k}, 1, size(_m_{k})), (m, b) -> named_struct('m', m, 'b', length(b), 'n', length(b) + length(m)))"
    step = step.selectExpr(*own, *[ours(f"if(size(_m_{k}) = 0, cast(array() as array<struct<m:string,b:int,n:int>>), {pieces.format(k=k)}) as _z_{k}") for k, _ in KINDS])
    stretches = f"aggregate(sequence(0, (size(_z_{{k}}) - 1) div {RUN}), named_struct('at', 0, 'out', cast(array() as array<int>)), (a, c) -> named_struct('at', a.at + aggregate(slice(_z_{{k}}, cast(c * {RUN} + 1 as int), {RUN}), 0, (v, x) -> v + x.n), 'out', array_append(a.out, a.at)), a -> a.out)"
    step = step.selectExpr("*", *[ours(f"if(size(_z_{k}) = 0, cast(array() as array<int>), {stretches.format(k=k)}) as _r_{k}") for k, _ in KINDS])
    walk = f"flatten(transform(_r_{{k}}, (at, c) -> aggregate(slice(_z_{{k}}, c * {RUN} + 1, {RUN}), named_struct('at', at, 'out', cast(array() as array<struct<start:int,end:int,m:string>>)), (a, x) -> named_struct('at', a.at + x.n, 'out', array_append(a.out, named_struct('start', a.at + x.b, 'end', a.at + x.n, 'm', x.m))), a -> a.out)))"
    step = step.selectExpr(*own, *[ours(f"{walk.format(k=k)} as _s_{k}") for k, _ in KINDS])
    long_enough = ours("filter(_s_assign, x") + f" -> length(regexp_extract(x.m, {_sql(ASSIGN)}, 1)) >= 8)"
    bare = "transform({s}, x -> named_struct('start', x.start, 'end', x.end))"
    parts = [f"'assign', {bare.format(s=long_enough)}", f"'access', {bare.format(s=ours('_s_access'))}", f"'hex', {bare.format(s=ours('_s_hex'))}", f"'tokens', {_battery(_parts(ours('_s_random')))}"]
    return step.selectExpr(*own, f"named_struct({', '.join(parts)}) as `{into}`")


def thresholds(scanned: DataFrame, found: str = "found") -> dict[int, int]:
    """For each length stratum, the least step (-ln p) of a find, by Benjamini and Hochberg's rule.

    Counts every token of every document; its steps are rounded towards no find.
    """
    tokens = scanned.select(F.explode(f"{found}.tokens").alias("t")).select("t.*")
    counts = save(tokens.groupBy("stratum", "step").agg(F.count("*").alias("all"), F.count_if("random").alias("random")), "token_counts")
    up = Window.partitionBy("stratum").orderBy(F.desc("step"))  # at most MOST_STEPS + 1 rows each
    ranked = counts.withColumn("above", F.sum("random").over(up)).withColumn("m", F.sum("all").over(Window.partitionBy("stratum")))
    best = ranked.where((F.col("above") > 0) & (-F.col("step") <= F.log(FDR * F.col("above") / F.col("m")))).groupBy("stratum").agg(F.min("step").alias("step"))
    return {r["stratum"]: r["step"] for r in best.collect()}  # TOP_STRATUM + 1 rows at most


def spans(scanned: DataFrame, least: dict[int, int], found: str = "found", into: str = "spans") -> DataFrame:
    """``scanned`` with an array of (start, rank, end, kind): base spans, and random tokens that meet none of them."""
    known = free_prefix(scanned) + "base"
    kind = lambda k, r: f"transform({found}.{k}, x -> named_struct('start', x.start, 'rank', {r}, 'end', x.end, 'kind', '{k}'))"
    base = f"array_sort(concat({kind('assign', 0)}, {kind('access', 1)}, {kind('hex', 2)}))"
    enough = " or ".join(f"(x.stratum = {s} and x.step >= {v})" for s, v in sorted(least.items())) or "false"
    added = f"transform(filter({found}.tokens, x -> x.random and ({enough}) and not exists({known}, b -> b.start < x.end and x.start < b.end)), x -> named_struct('start', x.start, 'rank', 3, 'end', x.end, 'kind', 'random'))"
    step = scanned.withColumn(known, F.expr(base))
    return step.withColumn(into, F.expr(f"array_sort(concat({known}, {added}))")).drop(known)


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with each find, overlapping ones together, replaced by ``marker``; no document goes.

    n_chars, where there is one, becomes the new length. Texts without finds stay as they are.
    """
    columns, p = docs.columns, free_prefix(docs)
    found, cuts, own, a, b = (p + n for n in ("found", "cuts", "spans", "a", "b"))
    keys = dict(zip((a, b), text_keys(F.col("text")), strict=True))
    with scratch(docs.sparkSession):  # only finds are written, not the texts, which are read once more
        any_find = " or ".join(f"size({found}.{k}) > 0" for k in ("assign", "access", "hex", "tokens"))
        scanned = save(scan(docs.select("text"), found).withColumns(keys).select(a, b, found), "scanned")
        told = spans(scanned.where(any_find), thresholds(scanned, found), found, own).where(f"size({own}) > 0").select(a, b, own).dropDuplicates([a, b])
        told = save(told, "told", keep=True)
    size = told.agg(F.count("*") + F.coalesce(F.sum(F.size(own)), F.lit(0))).first()[0]
    step = docs.withColumns({f"{k}_": v for k, v in keys.items()})
    step = step.join(F.broadcast(told) if size <= MOST_BROADCAST_ROWS else told, (step[f"{a}_"] == told[a]) & (step[f"{b}_"] == told[b]), "left")
    step = step.withColumn(own, F.coalesce(own, F.array().cast(told.schema[own].dataType)))
    merged = f"aggregate({own}, cast(array() as array<struct<s:int,e:int>>), (a, x) -> if(size(a) > 0 and x.start < element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.end)))), array_append(a, named_struct('s', x.start, 'e', x.end))))"
    step = step.withColumn(cuts, F.expr(merged))
    starts = f"concat(array(0), transform({cuts}, x -> x.e))"
    ends = f"concat(transform({cuts}, x -> x.s), array(length(text)))"
    text = f"if(size({own}) = 0, text, array_join(zip_with({starts}, {ends}, (a, b) -> substring(text, a + 1, b - a)), {_sql(marker)}))"
    step = step.withColumn("text", F.expr(text))
    if "n_chars" in columns:
        step = step.withColumn("n_chars", F.expr(f"if(size({own}) = 0, n_chars, length(text))").cast(docs.schema["n_chars"].dataType))
    return step.select(*[F.col(f"`{c}`") for c in columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    Starts and ends count code points, ends exclusive. A null text counts as empty; texts
    without finds have the digest of an empty string and empty spans; repeated rows get
    equal results; other columns are ignored.
    """
    scanned = save(scan(docs.select("doc_id", "text")).select("doc_id", "found"), "scanned")
    out = spans(scanned, thresholds(scanned))
    text = lambda a: f"array_join(transform({a}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return out.selectExpr("doc_id", *[f"cast(size(found.{k}) as bigint) as n_{k}" for k in ("assign", "access", "hex")], f"sha2({text('filter(spans, x -> x.rank < 3)')}, 256) as base_sha256", f"{text('spans')} as spans")
