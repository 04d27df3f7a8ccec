"""Planning over schemas: similarity, mapping, compatibility, differences, load order. All metadata-sized."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

PAIR_TABLES, PAIR_FIELDS, SUGGEST = 0.72, 0.85, 0.6


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # attribute type, as sql_type() gives
    required: bool = False
    max_length: int | None = None
    precision: int | None = None
    targets: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    writable: bool = True
    system: bool = False
    readable: bool = True
    identity: bool = False  # numbered by the system
    child_of: str = ""  # a part of another column, as its display name is
    behavior: str = ""  # what a time means: DateOnly, UserLocal or TimeZoneIndependent


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: str = ""
    keys: tuple[tuple[str, ...], ...] = ()  # alternate ones
    inactive_keys: tuple[tuple[str, ...], ...] = ()
    name_column: str = ""
    family: str = "SQL"  # TABULAR for files, whose key column is data too; PLATFORM
    schema: str = ""


def attribute_type(t: T.DataType) -> str:
    """The attribute type of a Spark type."""
    if isinstance(t, T.DecimalType):
        return "Decimal"
    names = {T.StringType: "String", T.LongType: "BigInt", T.IntegerType: "Integer", T.ShortType: "Integer", T.ByteType: "Integer", T.DoubleType: "Double", T.FloatType: "Double", T.BooleanType: "Boolean", T.DateType: "DateOnly", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.BinaryType: "File"}
    return names.get(type(t), "Other")


# SQL types by the attribute type they are read as.
SQL_TYPES = {
    "String": ("char", "nchar", "varchar", "nvarchar", "character varying", "character", "enum", "set", "sysname"),
    "Memo": ("text", "ntext", "xml", "mediumtext", "longtext", "tinytext", "json", "jsonb"),
    "Integer": ("tinyint", "smallint", "int", "integer", "mediumint", "int2", "int4", "year"),
    "BigInt": ("bigint", "int8"), "Decimal": ("decimal", "numeric"), "Money": ("money", "smallmoney"),
    "Double": ("float", "real", "double", "double precision", "float4", "float8"), "Boolean": ("bit", "boolean", "bool"),
    "DateTime": ("datetime", "datetime2", "smalldatetime", "timestamp without time zone", "timestamp with time zone", "datetimeoffset", "timestamptz"), "DateOnly": ("date",),
    "Uniqueidentifier": ("uniqueidentifier", "uuid"),
}


def sql_type(name: str) -> str:
    bare = re.sub(r"\(.*\)", "", name.lower()).strip()
    if re.search(r"\((max|-1)\)", name.lower()):
        return "Memo"
    return next((kind for kind, names in SQL_TYPES.items() if bare in names), "Other")


def table_of(name: str, schema: T.StructType, key: str = "") -> Table:
    return Table(name, tuple(Column(f.name, attribute_type(f.dataType), not f.nullable, f.metadata.get("maxLength"), getattr(f.dataType, "precision", None)) for f in schema), key)


# -- catalogues

# Columns that a system keeps itself, which differ by design.
SYSTEM_NAMES = ("createdon", "modifiedon", "createdby", "modifiedby", "versionnumber", "importsequencenumber", "overriddencreatedon", "timezoneruleversionnumber", "utcconversiontimezonecode")


def catalog_of(spark, database: str | None = None, constraints: Iterable[dict] = ()) -> list[Table]:
    """The tables of a database of the session's catalogue, by name, as discover_catalog() gives them."""
    return discover_catalog({t.name: spark.table(f"`{t.namespace[0]}`.`{t.name}`" if t.namespace else f"`{t.name}`").schema for t in sorted(spark.catalog.listTables(database), key=lambda t: t.name)}, constraints)


def discover_catalog(schemas: dict[str, T.StructType], constraints: Iterable[dict] = ()) -> list[Table]:
    """Tables from their schemas and constraints, which files don't hold themselves.

    A constraint has table, kind (PRIMARY, UNIQUE or FOREIGN), columns, and ``to`` (the
    table a FOREIGN one leads to). A key's columns are required.
    """
    own = list(constraints)
    out = []
    for name, schema in schemas.items():
        mine = [c for c in own if c["table"].lower() == name.lower()]
        primary = next((tuple(c["columns"]) for c in mine if c["kind"] == "PRIMARY"), ())
        base = table_of(name, schema, primary[0] if len(primary) == 1 else "")
        columns = tuple(replace(c, required=c.required or c.name in primary, targets=tuple(x["to"] for x in mine if x["kind"] == "FOREIGN" and list(x["columns"]) == [c.name])) for c in base.columns)
        unique = [tuple(c["columns"]) for c in mine if c["kind"] == "UNIQUE"]
        out.append(replace(base, columns=columns, keys=tuple(([primary] if len(primary) > 1 else []) + unique)))
    return out


def catalog_rows(tables: Iterable[Table]) -> list[tuple[str, int, str, str, bool, bool, bool, str]]:
    """(table, place, column, type, required, is key, is unique, references) of every column, to keep or join as data."""
    return [(t.name, i, c.name, c.type, c.required, c.name == t.key, (c.name,) in t.keys, ",".join(c.targets)) for t in tables for i, c in enumerate(t.columns, 1)]


def schema_filter(tables: Iterable[Table], schemas: Sequence[str] | None) -> list[Table]:
    """The tables of the named schemas, whatever their case; of all if none is named."""
    wanted = {s.lower() for s in schemas or ()}
    return [t for t in tables if not wanted or t.schema.lower() in wanted]


def migratable_columns(table: Table) -> list[str]:
    """Columns whose values can be carried over.

    No parts of other columns, none without data or that can't be read, no key that only
    means something in its system. What nothing can write is left out too, unless nothing
    of the table can be written: a file is read-only, and its flags say nothing.
    """
    others = [c for c in table.columns if c.name != table.key and not c.child_of]
    read_only = not any(c.writable for c in others)
    return [
        c.name for c in table.columns
        if not c.child_of and c.type not in RAW and c.readable and (c.name != table.key or table.family == "TABULAR") and (c.writable or read_only)
    ]


def comparable_columns(table: Table) -> list[str]:
    """Columns whose differences mean something: no parts of others, none that systems keep themselves."""
    return [c.name for c in table.columns if not c.child_of and c.name.lower() not in SYSTEM_NAMES]


def erd(tables: Sequence[Table]) -> tuple[list[dict], list[dict], list[tuple[str, str, str]]]:
    """Nodes (table, columns, key, depth below the tables it refers to, cycle), edges (parent, child, column, required, deferred), and references to other tables."""
    names = {t.name.lower(): t.name for t in tables}
    links = [(t.name, c.name, to, c.required) for t in tables for c in t.columns for to in c.targets]
    inside = [(a, c, names[to.lower()], r) for a, c, to, r in links if to.lower() in names]
    order = load_order([t.name for t in tables], [(a, b, not r) for a, _, b, r in inside])
    depth: dict[str, int] = {}
    for name in order.tables:  # parents first, but for what a cycle left open
        depth[name] = max((depth[b] + 1 for a, _, b, _ in inside if a == name and b != name and b in depth), default=0)
    cycles = {n: i for i, group in enumerate(order.unresolved + [sorted(p) for p in order.deferred if p[0] != p[1]]) for n in group}
    nodes = [{"table": t.name, "columns": len(t.columns), "key": t.key, "depth": depth[t.name], "cycle": cycles.get(t.name)} for t in tables]
    edges = [{"parent": b, "child": a, "column": c, "required": r, "deferred": (a, b) in order.deferred} for a, c, b, r in inside]
    return sorted(nodes, key=lambda n: (n["depth"], n["table"])), edges, [(a, c, to) for a, c, to, _ in links if to.lower() not in names]


# -- names

def bare(name: str) -> str:
    """A name without schema and short prefix, letters and digits only."""
    name = re.sub(r"^[a-z0-9]{1,8}_(?=[a-z])", "", name.lower().rsplit(".", 1)[-1])
    return re.sub(r"[^a-z0-9]", "", name)


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens(name: str) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()) if t}


def similarity(a: str, b: str) -> float:
    """The better of the edit-distance ratio of bare names and the shared part of their words."""
    x, y = bare(a), bare(b)
    edit = 1 - levenshtein(x, y) / max(len(x), len(y), 1)
    p, q = tokens(a), tokens(b)
    return max(edit, len(p & q) / len(p | q) if p | q else 0.0)


def singular(name: str) -> str:
    n = bare(name)
    return n[:-3] + "y" if n.endswith("ies") else n[:-2] if re.search(r"(s|x|ch|sh)es\Z", n) else n[:-1] if n.endswith("s") and not n.endswith("ss") else n


def table_similarity(a: str, b: str) -> float:
    x, y = singular(a), singular(b)
    if x == y:
        return 1.0
    inside = min(len(x), len(y)) >= 4 and (x in y or y in x)
    return max(similarity(a, b), 0.85 if inside else 0.0)


def pair_greedily(left: Sequence[str], right: Sequence[str], score, least: float) -> list[tuple[str, str, float]]:
    """One-to-one pairs, best first, ties by name."""
    ranked = sorted(((-score(a, b), a, b) for a in left for b in right if score(a, b) >= least))
    used_a, used_b, out = set(), set(), []
    for s, a, b in ranked:
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b)
            out.append((a, b, -s))
    return out


def pair_tables(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str, float]]:
    return pair_greedily(left, right, table_similarity, PAIR_TABLES)


def pair_fields(left: Table, right: Table) -> list[tuple[str, str, float]]:
    kinds = {(a.name, b.name): compatibility(a, b) for a in left.columns for b in right.columns}
    return pair_greedily([c.name for c in left.columns], [c.name for c in right.columns], lambda a, b: 0.0 if kinds[a, b] == "INCOMPATIBLE" else 1.0 if bare(a) == bare(b) else similarity(a, b), PAIR_FIELDS)


def field_gaps(left: Table, right: Table) -> tuple[list[str], list[str]]:
    """Columns whose bare name only one side has."""
    a, b = {bare(c.name): c.name for c in left.columns}, {bare(c.name): c.name for c in right.columns}
    return sorted(a[k] for k in a.keys() - b.keys()), sorted(b[k] for k in b.keys() - a.keys())


# -- types

TEXT, NUMBERS, TIMES = {"String", "Memo"}, {"Integer", "BigInt", "Decimal", "Money", "Double"}, {"DateTime", "DateOnly"}
REFERENCES, CHOICES, RAW = {"Lookup", "Customer", "Owner"}, {"Picklist", "State", "Status", "MultiSelectPicklist"}, {"Image", "File", "Virtual", "Other"}
_WIDTH = {"Integer": 1, "BigInt": 2, "Decimal": 3, "Money": 3, "Double": 3}


def compatibility(source: Column, target: Column) -> str:
    """COMPATIBLE, CONVERSION_REQUIRED, LOSSY or INCOMPATIBLE."""
    s, t = source.type, target.type
    if s in RAW or t in RAW:
        return "COMPATIBLE" if s == t and s not in {"Virtual", "Other"} else "INCOMPATIBLE"
    if s in TEXT and t in TEXT:
        return "LOSSY" if target.max_length and (source.max_length or 1 << 30) > target.max_length and not (s == "String" and source.max_length is None) else "COMPATIBLE"
    if t in TEXT:
        return "CONVERSION_REQUIRED"
    if s in NUMBERS and t in NUMBERS:
        if _WIDTH[s] > _WIDTH[t]:
            return "LOSSY"
        return "LOSSY" if s in {"Decimal", "Money", "Double"} and target.precision and (source.precision or 38) > target.precision else "COMPATIBLE"
    if s == t:
        return "COMPATIBLE" if s not in REFERENCES or set(source.targets) <= set(target.targets) or not target.targets else "INCOMPATIBLE"
    if s == "DateOnly" and t == "DateTime":
        return "COMPATIBLE"
    if s == "DateTime" and t == "DateOnly":
        return "LOSSY"
    if s in TEXT or (s in CHOICES | {"Boolean"} and t in NUMBERS) or (s in NUMBERS | CHOICES | {"Boolean"} and t in CHOICES) or (s in NUMBERS and t == "Boolean"):
        return "CONVERSION_REQUIRED"
    if s in REFERENCES and t == "Uniqueidentifier" or s == "Uniqueidentifier" and t in REFERENCES:
        return "CONVERSION_REQUIRED"
    return "INCOMPATIBLE"


# What a number widens to within one kind of system.
WIDENING = {"Integer": ("BigInt", "Decimal", "Double", "Money"), "BigInt": ("Decimal", "Double"), "Decimal": ("Double", "Money"), "Money": ("Decimal", "Double")}


def type_compatibility(source: Column, target: Column) -> tuple[bool, bool]:
    """(compatible, lossy) of two columns of one kind of system, by their types alone."""
    s, t = source.type, target.type
    if s in REFERENCES and t in REFERENCES:
        missing = set(source.targets) - set(target.targets)
        if source.targets and missing == set(source.targets):
            return False, False
        return True, bool(missing) or (s == "Customer" and t != "Customer")
    if s == t:
        return True, False
    if s in TEXT and t in TEXT:
        return True, s == "Memo"
    if s in NUMBERS and t in NUMBERS:
        return True, t not in WIDENING.get(s, ())
    return False, False


def field_verdict(source: Column | None, target: Column | None, cross: bool = False) -> str:
    """COMPATIBLE, LOSSY, INCOMPATIBLE or, between kinds of systems (``cross``), also CONVERSION_REQUIRED."""
    if source is None or target is None:
        return "INCOMPATIBLE"
    if cross:
        return compatibility(source, target)
    fits, lossy = type_compatibility(source, target)
    return "INCOMPATIBLE" if not fits else "LOSSY" if lossy else "COMPATIBLE"


def needs_choice_map(source: Column, target: Column | None, cross: bool = False) -> bool:
    """Whether values have to be paired with a choice's options before a load."""
    return target is not None and target.type in {"Picklist", "State", "Status"} and (source.type != target.type or cross)


def schema_diff(source: Iterable[Table], target: Iterable[Table]) -> list[dict]:
    """A row for each table and column: MATCH, SOURCE_ONLY, TARGET_ONLY, DIFFERENT or INCOMPATIBLE, what differs, and whether it breaks a load."""
    out = []
    a, b = {t.name.lower(): t for t in source}, {t.name.lower(): t for t in target}
    for name in sorted(a.keys() | b.keys()):
        s, t = a.get(name), b.get(name)
        if not (s and t):
            out.append({"table": name, "column": "", "status": "SOURCE_ONLY" if s else "TARGET_ONLY", "properties": "", "breaking": bool(s)})
            continue
        x, y = {c.name.lower(): c for c in s.columns}, {c.name.lower(): c for c in t.columns}
        for column in sorted(x.keys() | y.keys()):
            p, q = x.get(column), y.get(column)
            if not (p and q):
                out.append({"table": name, "column": column, "status": "SOURCE_ONLY" if p else "TARGET_ONLY", "properties": "", "breaking": bool(q and q.required)})
                continue
            differs = [n for n in ("type", "required", "max_length", "precision", "targets", "options", "behavior") if getattr(p, n) != getattr(q, n)]
            verdict = compatibility(p, q)
            status = "INCOMPATIBLE" if verdict == "INCOMPATIBLE" else "DIFFERENT" if differs else "MATCH"
            out.append({"table": name, "column": column, "status": status, "properties": ",".join(differs), "breaking": status == "INCOMPATIBLE" or verdict == "LOSSY" or q.required and not p.required})
    return out


def field_rows(tables: Iterable[Table]) -> list[tuple[str, str, str]]:
    """(table, column, type) rows, to join schemas as data."""
    return [(t.name.lower(), c.name.lower(), c.type) for t in tables for c in t.columns]


# -- mapping

def auto_map(source: Table, target: Table) -> list[dict]:
    """A row for each source column: AUTO_MAPPED by exact name, INCOMPATIBLE, IGNORED for system columns, or UNMAPPED with a suggestion."""
    own = {c.name.lower(): c for c in target.columns}
    out = []
    for c in source.columns:
        hit = own.get(c.name.lower())
        if c.system:
            out.append({"source": c.name, "target": None, "status": "IGNORED", "suggestion": None})
        elif hit and hit.writable:
            ok = compatibility(c, hit) != "INCOMPATIBLE"
            out.append({"source": c.name, "target": hit.name if ok else None, "status": "AUTO_MAPPED" if ok else "INCOMPATIBLE", "suggestion": None})
        else:
            ranked = sorted(((-similarity(c.name, t.name), t.name) for t in target.columns if t.writable and compatibility(c, t) != "INCOMPATIBLE"))
            out.append({"source": c.name, "target": None, "status": "UNMAPPED", "suggestion": ranked[0][1] if ranked and -ranked[0][0] >= SUGGEST else None})
    return out


# Common names of tables in older systems, and what they are called elsewhere.
SYNONYMS = {
    "customer": ("account", "contact"), "client": ("account",), "company": ("account",), "organisation": ("account",), "organization": ("account",),
    "person": ("contact",), "people": ("contact",), "contact": ("contact",), "order": ("salesorder",), "salesorder": ("salesorder",),
    "orderline": ("salesorderdetail",), "orderdetail": ("salesorderdetail",), "product": ("product",), "item": ("product",), "territory": ("territory",), "region": ("territory",),
}
LEAST_CANDIDATE, SYNONYM_SCORE, CANDIDATES = 55, 80, 5


def object_map(source: str, targets: Sequence[str]) -> tuple[str, list[tuple[str, int]]]:
    """(status, candidates with their confidence in per cent): EXACT, AUTO_SUGGESTED or UNMAPPED; the best five, ties by name."""
    if source in targets:
        return "EXACT", [(source, 100)]
    own, known = singular(source), SYNONYMS.get(singular(source), ())
    scored = [(t, max(int(table_similarity(source, t) * 100 + 0.5), SYNONYM_SCORE if t in known or singular(t) in known else 0)) for t in targets]
    best = sorted((s for s in scored if s[1] >= LEAST_CANDIDATE), key=lambda s: (-s[1], s[0]))[:CANDIDATES]
    return ("AUTO_SUGGESTED" if best and own else "UNMAPPED"), best


def suggest_comparison(left: Table, right: Table) -> dict:
    """What to compare two tables by: key (pairs; none if no column is unique on both sides), fields, and why."""
    unique = lambda t, c: c == t.key or (c,) in t.keys
    other = {bare(c.name): c.name for c in right.columns}
    keys = sorted((c.name != left.key, i, c.name) for i, c in enumerate(left.columns) if bare(c.name) in other and unique(left, c.name) and unique(right, other[bare(c.name)]))
    key = [(keys[0][2], other[bare(keys[0][2])])] if keys else []
    only = lambda t: replace(t, columns=tuple(c for c in t.columns if c.name in comparable_columns(t)))
    used = {x for pair in key for x in pair}
    fields = [(a, b) for a, b, _ in pair_fields(only(left), only(right)) if not {a, b} & used]
    why = f"Matching on {key[0][0]}, comparing {len(fields)} column(s)." if key else "No column on both sides is guaranteed unique, so choose the one that identifies a record."
    return {"left": left.name, "right": right.name, "key": key, "fields": fields, "rationale": why}


# -- load order

@dataclass
class Order:
    tables: list[str]
    deferred: list[tuple[str, str]] = field(default_factory=list)  # nullable references filled in a second pass
    unresolved: list[list[str]] = field(default_factory=list)  # cycles that only required references form


def load_order(tables: Sequence[str], references: Sequence[tuple[str, str, bool]]) -> Order:
    """Parents first. ``references`` are (from, to, nullable); cycles are broken at nullable ones, most referenced table first, ties by name."""
    live = {(a, b): all(n for x, y, n in references if (x, y) == (a, b)) for a, b, _ in references if a in tables and b in tables and a != b}
    deferred = [(a, b) for a, b, n in references if a == b and a in tables]
    done: list[str] = []
    left, unresolved = set(tables), []
    while left:
        free = sorted(t for t in left if not any(a == t and b in left for a, b in live))
        if free:
            done.append(free[0])
            left.remove(free[0])
            continue
        # every table waits for another: one on a cycle gives way
        cycle = _cycle(left, live)
        weak = sorted((-sum(b == a2 for _, b in live for a2 in [a]), a, b) for a, b in live if live[a, b] and a in cycle and b in cycle)
        if weak:
            _, a, b = weak[0]
            deferred.append((a, b))
            del live[a, b]
        else:
            unresolved.append(sorted(cycle))
            a = min(cycle)
            for pair in [p for p in live if p[0] == a and p[1] in cycle]:
                del live[pair]
    return Order(done, sorted(set(deferred)), unresolved)


def _cycle(left: set[str], live: dict[tuple[str, str], bool]) -> set[str]:
    """The tables of one cycle, found by following references from the first table by name."""
    path: list[str] = [min(left)]
    while True:
        step = min(b for a, b in live if a == path[-1] and b in left)
        if step in path:
            return set(path[path.index(step) :])
        path.append(step)


def uniqueness_basis(match: str, key: Sequence[str]) -> str:
    """What a uniqueness check can prove; a primary key proves nothing about business duplicates."""
    if match == "BUSINESS_KEY":
        return "NOT_VERIFIED" if not key else "BUSINESS_KEY" if len(key) == 1 else "COMPOSITE_BUSINESS_KEY"
    return match if match in ("PRIMARY_KEY", "ALTERNATE_KEY") else "NOT_VERIFIED"
