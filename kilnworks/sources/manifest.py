"""What a table has to hold, as a small document, and the deviations of a table from it.

A manifest names the columns in order with their types, the rows, the key and the grain, nulls by column, the sets of
values that coverage columns take, ranges, constants, totals, and a digest of each part of the rows (by hash of the
key). It is a plain dict that JSON can hold. Everything but uniqueness comes from one pass that sums by part and by values of
the coverage columns; key and grain share another. Digests of parts are sums and exclusive ors of row hashes, so they don't
depend on order, files or tasks, can be merged, and tell which part differs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 64


@dataclass(frozen=True)
class Spec:
    """What a manifest is about. Coverage columns take few values; constants hold one value in all rows."""

    key: list[str]
    grain: list[str] = field(default_factory=list)
    coverage: list[str] = field(default_factory=list)
    ranges: list[str] = field(default_factory=list)
    constants: list[str] = field(default_factory=list)
    totals: list[str] = field(default_factory=list)


def _marked(df: DataFrame, columns: list[str]) -> list[Column]:
    """Each column with a mark that tells null, as hashes skip nulls; nested ones as JSON."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    parts = [(F.col(c).isNull(), F.to_json(c, {"ignoreNullFields": "false"}) if c in nested else F.col(c)) for c in columns]
    return [x for pair in parts for x in pair]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns in the order of their names."""
    return F.xxhash64(*_marked(df, sorted(df.columns)))


def _part(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part")


def digests(df: DataFrame, key: list[str], parts: int = PARTS) -> DataFrame:
    """part, rows, xor and total: the digest of the rows of each part."""
    h = row_hash(df)
    return df.groupBy(_part(key, parts)).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def _text(value: object) -> str | None:
    return None if value is None else format(value, "f") if isinstance(value, Decimal) else str(value)


def _total(df: DataFrame, c: str) -> Column:
    """Exact for whole and decimal numbers; others are rounded to 6 places in the end, as their sums depend on their order."""
    return F.sum(c if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("decimal(38,6)"))


def _repeats(df: DataFrame, keys: list[list[str]]) -> list[int]:
    """Rows beyond the first of each key, for each list of columns, by one grouping. Keys travel as digests of 128 bits."""

    def digest(i: int) -> Column:
        marked = _marked(df, keys[i])
        return F.struct(F.lit(i).alias("_key"), F.xxhash64(*marked).alias("_a"), F.xxhash64(F.lit("key"), *marked).alias("_b"))

    # Dealt out before they are grouped: keys hardly repeat inside a task, so there is nothing to sum up before.
    rows = df.select(F.inline(F.array(*map(digest, range(len(keys)))))).repartition("_key", "_a", "_b")
    by = rows.groupBy("_key", "_a", "_b").agg(F.count("*").alias("n"))
    found = dict(map(tuple, by.groupBy("_key").agg(F.sum(F.col("n") - 1)).collect()))
    return [found.get(i, 0) for i in range(len(keys))]


FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _measured(df: DataFrame, spec: Spec, parts: int, constants: dict[str, str | None] | None = None) -> dict:
    """Rows, nulls, sets, bounds, totals and digests by part of what df has of spec.

    Rows are summed by part and by the values of coverage columns, which are few; then the sums are. With constants it has
    the rows that differ from each ("off"), else the least value of each. Bounds of text have a pass of their own, as Spark
    would sort all rows for them in a grouping.
    """
    have, kinds = set(df.columns), {f.name: f.dataType for f in df.schema.fields}
    sets = {f"set {c}": c for c in spec.coverage if c in have}
    least = {f"constant {c}": c for c in spec.constants} if constants is None else {}
    counts = {"rows": F.count("*"), **{f"null {c}": F.count_if(F.col(c).isNull()) for c in df.columns}}
    counts |= {f"off {c}": F.count_if(~F.col(c).cast("string").eqNullSafe(F.lit(v).cast("string"))) for c, v in (constants or {}).items() if c in have}
    totals = {f"total {c}": _total(df, c) for c in spec.totals if c in have}
    ranges = {f"{n} {c}": (f, c) for c in spec.ranges if c in have for n, f in (("least", F.min), ("most", F.max))}
    bounds = {name: (f, c) for name, (f, c) in ranges.items() if isinstance(kinds[c], FIXED)}
    loose = [f(c).cast("string").alias(name) for name, (f, c) in ranges.items() if name not in bounds]

    h = row_hash(df)
    asks = [*[x.alias(name) for name, x in (counts | totals).items()], *[f(c).alias(name) for name, (f, c) in bounds.items()], F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total")]
    part = _part(spec.key, parts) if have >= set(spec.key) else F.lit(None).cast("int").alias("part")
    by = df.groupBy(part, *[F.col(c).cast("string").alias(name) for name, c in (sets | least).items()]).agg(*asks)
    sums = [F.sum(name).alias(name) for name in totals]
    ends = [*[f(name).alias(name) for name, (f, _) in bounds.items()], *[F.min(name).alias(name) for name in least]]
    by = by.groupBy("part").agg(*[F.sum(name).alias(name) for name in counts], *sums, *ends, F.bit_xor("xor").alias("xor"), F.sum("total").alias("total"), *[F.collect_set(name).alias(name) for name in sets])
    digest = F.collect_list(F.struct("part", "rows", "xor", "total")).alias("digests")  # one for each part
    one = by.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts], *sums, *ends, *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in sets], digest)
    rounded = {name: F.round(name, 6) if kinds[name[len("total ") :]] in (T.DoubleType(), T.FloatType()) else F.col(name) for name in totals}
    found = one.withColumns({name: x.cast("string") for name, x in (rounded | {name: F.col(name) for name in bounds}).items()}).first().asDict()
    found["digests"] = {str(r.part): [r.rows, str(r.xor), _text(r.total)] for r in found["digests"]}
    return found | (df.agg(*loose).first().asDict() if loose else {})


def describe(df: DataFrame, spec: Spec, parts: int = PARTS) -> dict:
    """The manifest of a table that is known to be right."""
    found = _measured(df, spec, parts)
    return {
        "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields],
        "rows": found["rows"],
        "key": spec.key,
        "grain": spec.grain,
        "nulls": {c: found[f"null {c}"] for c in df.columns},
        "coverage": {c: found[f"set {c}"] for c in spec.coverage},
        "ranges": {c: [found[f"least {c}"], found[f"most {c}"]] for c in spec.ranges},
        "constants": {c: found[f"constant {c}"] for c in spec.constants},
        "totals": {c: found[f"total {c}"] for c in spec.totals},
        "digests": found["digests"],
        "parts": parts,
    }


def verify(df: DataFrame, manifest: dict) -> DataFrame:
    """check, item, bad and ok: how far a table is from its manifest, one row for each statement.

    bad counts columns that differ or stand elsewhere, rows too many or too few, rows that repeat key or grain, nulls too
    many or too few, values beyond or missing from a set, bounds that differ, rows that differ from a constant, the
    distance of a total, and parts whose digest differs (one row for each of those, too). A column that is missing
    breaks every statement about it.
    """
    spec = Spec(manifest["key"], manifest["grain"], list(manifest["coverage"]), list(manifest["ranges"]), list(manifest["constants"]), list(manifest["totals"]))
    have, found = set(df.columns), _measured(df, spec, manifest["parts"], manifest["constants"])
    columns = [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
    wanted = manifest["columns"]
    rows: list[tuple[str, str, float | None]] = [("columns", "", float(sum(a != b for a, b in zip(columns, wanted, strict=False)) + abs(len(columns) - len(wanted)))), ("rows", "", float(abs(found["rows"] - manifest["rows"])))]
    keys = [name for name in ("key", "grain") if manifest[name] and have >= set(manifest[name])]
    repeats = dict(zip(keys, _repeats(df, [manifest[name] for name in keys]) if keys else [], strict=True))
    rows += [(name, ",".join(manifest[name]), float(repeats[name]) if name in repeats else None) for name in ("key", "grain") if manifest[name]]
    rows += [("nulls", c, float(abs(found[f"null {c}"] - n)) if c in have else None) for c, n in manifest["nulls"].items()]
    rows += [("coverage", c, float(len(set(found[f"set {c}"]) ^ set(values))) if c in have else None) for c, values in manifest["coverage"].items()]
    rows += [("range", c, float((found[f"least {c}"] != low) + (found[f"most {c}"] != high)) if c in have else None) for c, (low, high) in manifest["ranges"].items()]
    rows += [("constant", c, float(found[f"off {c}"]) if c in have else None) for c in manifest["constants"]]
    for c, total in manifest["totals"].items():
        now = found.get(f"total {c}")
        rows.append(("total", c, (0.0 if now == total else None if now is None or total is None else float(abs(Decimal(now) - Decimal(total)))) if c in have else None))
    if have >= set(manifest["key"]):
        now = found["digests"]
        parts = sorted({p for p in now.keys() | manifest["digests"].keys() if now.get(p) != manifest["digests"].get(p)}, key=int)
        rows += [("digest", "", float(len(parts))), *[("digest of part", p, 1.0) for p in parts]]
    else:
        rows.append(("digest", "", None))
    made = df.sparkSession.createDataFrame(rows, "check string, item string, bad double")
    return made.withColumn("ok", F.coalesce(F.col("bad") == 0, F.lit(False)))
