"""Keys, suggested rules, relations and health, measured from the data."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")
NUMERIC = (*INTEGERS, "float", "double")
DATES = ("date", "timestamp", "timestamp_ntz")
KEY_TYPES = (*INTEGERS, "string", *DATES)
NESTED = ("array", "map", "struct", "binary", "variant")
EXHAUSTIVE = 4  # widest key that is searched among all combinations
SKETCHES = 256  # in one aggregation
EXACT = 16  # combinations whose first share of values one aggregation counts
SHARE = 64  # that share: one in so many hashes
PIECE = 2_000_000  # hashes a task counts
SKETCH_ERROR = 0.08  # five standard errors of a sketch

# Names that announce a magnitude, and names that announce a key.
MAGNITUDE_NAMES = (
    "monto", "importe", "amount", "precio", "price", "unidad", "cantidad", "qty", "dias", "edad", "age",
    "limite", "limit", "saldo", "cuota", "pago", "paid", "venta", "total", "ingreso", "costo",
)
KEY_NAME = re.compile(r"(^|_)(id|code|key|sku|num|fk)$|^(id|code|key|sku)_", re.I)


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def profile(df: DataFrame) -> dict[str, dict]:
    """Rows, nulls, least value, sum and estimated distinct values of every column, from one aggregation."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    usable = [(n, t) for n, t in df.dtypes if not t.startswith(NESTED)]
    for i, (name, kind) in enumerate(usable):
        exprs += [F.count(name).alias(f"f{i}"), sketch([name]).alias(f"d{i}")]
        if is_numeric(kind):
            exprs += [F.min(name).alias(f"m{i}"), F.sum(F.col(name).cast("double")).alias(f"s{i}")]
        if kind == "string":
            stripped = F.regexp_replace(F.trim(F.col(name)), r"[$\s.,-]", "")
            exprs.append(F.avg(stripped.rlike(r"^\d+$").cast("int")).alias(f"t{i}"))
    row = df.agg(*exprs).first().asDict()
    out = {}
    for i, (name, kind) in enumerate(usable):
        out[name] = {
            "type": kind,
            "rows": row["rows"],
            "filled": row[f"f{i}"],
            "distinct": row[f"d{i}"] or 0,
            "min": row.get(f"m{i}"),
            "sum": row.get(f"s{i}"),
            "numeric_text": (row.get(f"t{i}") or 0) > 0.95,
        }
    return out


def sketch(columns: Sequence[str]) -> Column:
    """Estimated distinct combinations of the columns: one mergeable sketch of a few kilobytes."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*columns), F.lit(12)))


def estimates(df: DataFrame, combos: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Estimated distinct values of every combination, `SKETCHES` of them an aggregation."""
    out = {}
    for at in range(0, len(combos), SKETCHES):
        some = combos[at : at + SKETCHES]
        row = df.agg(*[sketch(c).alias(f"e{i}") for i, c in enumerate(some)]).first()
        out.update({c: row[f"e{i}"] or 0 for i, c in enumerate(some)})
    return out


def digest(combo: Sequence[str]) -> Column:
    """The values of some columns as one digest, nulls and borders told apart."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string") for c in combo]), {"ignoreNullFields": "false"}))


def repeating(df: DataFrame, combos: Sequence[Sequence[str]]) -> list[bool]:
    """Which combinations repeat a value among those whose hash falls into one share of `SHARE`.

    All rows of such a value are seen, so a repeat is proof; the lack of one is not.
    """
    first = [F.pmod(F.xxhash64(*combo), F.lit(SHARE)) == 0 for combo in combos]
    tuples = [F.when(there, F.struct(F.lit(i).alias("i"), digest(combo).alias("h"))) for i, (combo, there) in enumerate(zip(combos, first))]
    counted = df.select(F.inline(F.array_compact(F.array(*tuples)))).groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"))
    found = {r.i for r in counted.where("n > 1").select("i").distinct().collect()}
    return [i in found for i in range(len(combos))]


def unique(df: DataFrame, combo: Sequence[str], rows: int | None = None) -> bool:
    """Whether a combination repeats no value, from its 64-bit hashes; those that repeat are compared by their values.

    Hashes are dealt out before they are counted, in pieces of bounded size: nearly all differ, so counting them first would only spill.
    """
    hashed = F.xxhash64(*combo)
    hashes = df.select(hashed.alias("h"))
    dealt = hashes.repartition("h") if rows is None else hashes.repartition(max(1, -(-rows // PIECE)), "h")
    twice = dealt.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    if twice.isEmpty():
        return True
    same = df.withColumn("__h", hashed).join(twice, F.col("__h") == F.col("h"), "left_semi")
    return same.groupBy(digest(combo).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def unique_among(df: DataFrame, combos: Sequence[Sequence[str]]) -> list[bool]:
    """Which combinations repeat no value."""
    return [unique(df, combo) for combo in combos]


def first_unique(df: DataFrame, combos: Sequence[Sequence[str]], rows: int) -> Sequence[str] | None:
    """The first combination that repeats no value, if any.

    A share of the values of all of them rules most out in one aggregation; what is
    left is decided over all rows one by one, up to the first that is unique.
    """
    for at in range(0, len(combos), EXACT):
        some = combos[at : at + EXACT]
        ruled_out = repeating(df, some) if len(some) > 1 else [False]
        for combo, out in zip(some, ruled_out):
            if not out and unique(df, combo, rows):
                return combo
    return None


def candidate_key(df: DataFrame, declared: Sequence[str] | None = None, stats: Mapping[str, dict] | None = None,
                  exhaustive: int = EXHAUSTIVE) -> list[str] | None:
    """The declared key if it is one, else the smallest combination that is, columns in table order.

    Combinations are searched level by level.  A level's candidates are those
    whose parts could reach the row count; one mergeable sketch each, in shared
    aggregations, leaves a few, and exact counts of their hashes decide among these.  Past `exhaustive` columns the key is a minimal one: columns are
    given up from the last to the first while the rest stays unique.  A table
    whose whole rows repeat has no key, which one check of all columns tells.
    """
    stats = stats or profile(df)
    if not stats:
        return None
    rows = next(iter(stats.values()))["rows"]
    full = [c for c, s in stats.items()
            if s["filled"] == rows and s["type"] in KEY_TYPES and not c.endswith("_hash")]
    if declared:
        usable = [c for c in declared if c in stats and stats[c]["filled"] == rows]
        if usable and unique(df, usable, rows):
            return usable
    if not full:
        return None
    if rows <= 1:
        return full[:1]
    enough = rows * (1 - SKETCH_ERROR)
    known = {(c,): stats[c]["distinct"] for c in full}
    if estimates(df, [tuple(full)])[tuple(full)] < enough:
        return None
    for width in range(1, min(exhaustive, len(full)) + 1):
        combos = list(combinations(full, width))
        if width > 1:
            reach = {c: min(known[c[:i] + c[i + 1 :]] * max(1, known[(c[i],)]) for i in range(width)) for c in combos}
            known.update({c: r for c, r in reach.items() if r * (1 + SKETCH_ERROR) ** 2 < rows})
            known.update(estimates(df, [c for c in combos if c not in known]))
        likely = [c for c in combos if known[c] >= enough]
        found = first_unique(df, likely, rows)
        if found:
            return list(found)
    if len(full) <= exhaustive or not unique(df, full, rows):
        return None
    kept = list(full)
    for column in reversed(full):
        fewer = [c for c in kept if c != column]
        if estimates(df, [tuple(fewer)])[tuple(fewer)] >= enough and unique(df, fewer, rows):
            kept = fewer
    return kept


def candidate_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = []
    for name, df in tables.items():
        key = candidate_key(df)
        rows.append((name, " + ".join(key) if key else None, len(key or [])))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, key string, columns bigint")


def numeric_text_columns(df: DataFrame) -> DataFrame:
    """Text columns whose values are digits once marks and blanks are removed."""
    texts = [n for n, t in df.dtypes if t == "string"]
    rows = []
    for name in texts:
        filled = F.trim(F.col(name)) != ""
        digits = F.regexp_replace(F.trim(F.col(name)), r"[$\s.,-]", "").rlike(r"^\d+$")
        rows.append(F.struct(F.lit(name).alias("column_name"), F.avg(F.when(filled, digits.cast("int"))).alias("share")))
    return (
        df.agg(F.array(*rows).alias("c"))
        .select(F.inline("c"))
        .select("column_name", F.round("share", 6).alias("share"), F.coalesce(F.col("share") > 0.95, F.lit(False)).alias("numeric_text"))
    )


def contained(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Share of one column's distinct values that exist in another column."""
    a = left.select(F.col(left_column).alias("v")).where("v is not null").distinct()
    b = right.select(F.col(right_column).alias("k"), F.lit(1).alias("hit")).where("k is not null").distinct()
    return a.join(b, F.col("v") == F.col("k"), "left").agg(
        F.count(F.lit(1)).alias("values"),
        F.count("hit").alias("found"),
        F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("share"),
    )


def canonical(column: str, kind: str) -> Column:
    """A value as text that is equal for equal values of its family."""
    c = F.col(column)
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("double").cast("string"))
    return c.cast("timestamp_ntz").cast("string") if kind in DATES else c.cast("string")


def inclusions(
    tables: Mapping[str, DataFrame], pairs: Collection[tuple[tuple[str, str], tuple[str, str]]] | None = None
) -> DataFrame:
    """How far each column's values exist in other columns, for all pairs from one job.

    Every column in question is unpivoted once to (column, value, rows); the columns
    that share a value meet in that value's group, which holds a row a column at
    most, and pairs are counted from these groups.  `pairs` names the wanted
    ((table, column), (table, column)); by default all of one family of types.

    Rows: from_table, from_column, to_table, to_column; rows, filled, values and most
    (the rows of the most frequent value) of the from column; found (values that exist
    in the other column) and found_rows.  Each column also meets itself.
    """
    kinds = {(t, c): k for t, df in tables.items() for c, k in df.dtypes if not k.startswith(NESTED)}
    if pairs is None:
        pairs = {(a, b) for a in kinds for b in kinds if _family(kinds[a]) == _family(kinds[b])}
    ends = sorted({e for p in pairs for e in p})
    number = {e: i for i, e in enumerate(ends)}
    wanted = sorted({number[a] * len(ends) + number[b] for a, b in pairs} | {i * len(ends) + i for i in range(len(ends))})
    spark = next(iter(tables.values())).sparkSession
    shape = "from_table string, from_column string, to_table string, to_column string"
    if not ends:
        return spark.createDataFrame([], f"{shape}, rows bigint, filled bigint, values bigint, most bigint, found bigint, found_rows bigint")
    parts = []
    for name, df in tables.items():
        mine = [
            F.struct(F.lit(number[name, c]).alias("c"), F.lit(_family(kinds[name, c])).alias("f"), canonical(c, kinds[name, c]).alias("v"))
            for c in df.columns if (name, c) in number
        ]
        if mine:
            parts.append(df.select(F.inline(F.array(*mine))))
    values = reduce(DataFrame.unionAll, parts).groupBy("c", "f", "v").agg(F.count(F.lit(1)).alias("n"))
    met = values.groupBy("f", "v").agg(F.collect_list(F.struct("c", "n")).alias("of"))
    sides = met.select("v", "of", F.inline("of")).select("v", "c", "n", F.explode("of.c").alias("d"))
    asked = F.array_contains(F.lit(wanted), F.col("c") * len(ends) + F.col("d"))
    there = F.col("v").isNotNull()
    counted = sides.where(asked).groupBy("c", "d").agg(
        F.sum("n").alias("rows"), F.count_if(there).alias("found"),
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("found_rows"), F.max(F.when(there, F.col("n"))).alias("most"),
    )
    own = counted.where("c = d").select(
        F.col("c").alias("o"), "rows", F.col("found_rows").alias("filled"), F.col("found").alias("values"), F.coalesce("most", F.lit(0)).alias("most")
    )
    met_own = own.join(counted.select("c", "d", "found", "found_rows"), F.col("o") == F.col("c"))
    names = spark.createDataFrame([(i, *e) for e, i in number.items()], "i int, t string, k string")
    left = names.select(F.col("i").alias("c"), F.col("t").alias("from_table"), F.col("k").alias("from_column"))
    right = names.select(F.col("i").alias("d"), F.col("t").alias("to_table"), F.col("k").alias("to_column"))
    return met_own.join(left, "c").join(right, "d").select(
        "from_table", "from_column", "to_table", "to_column", "rows", "filled", "values", "most", "found", "found_rows"
    )


def column_facts(tables: Mapping[str, DataFrame], pairs: Collection) -> tuple[dict, dict]:
    """({column: its own counts}, {(column, other): overlap}) of `inclusions`, a row a pair of columns."""
    own, met = {}, {}
    for r in inclusions(tables, pairs).collect():
        a, b = (r.from_table, r.from_column), (r.to_table, r.to_column)
        if a == b:
            own[a] = r
        met[a, b] = r
    return own, met


def _names_a_key(column: str, key: str | None) -> bool:
    return column == key or bool(KEY_NAME.search(column)) or column.lower().endswith("key")


def suggest_rules(tables: Mapping[str, DataFrame], declared: Sequence[Mapping] = (), signs: int | None = None) -> DataFrame:
    """Rules the data already obeys: key, row floor, signs and references.

    A reference holds where over 95 % of a column's filled ROWS name a key of the
    other table; all of them are measured in one job.  `signs` bounds the sign
    rules of a table for display; by default every column that fits has one.
    """
    have = {(r["table"], r["type"], r.get("column")) for r in declared}
    out = []

    def add(severity, table, kind, column=None, value=None, to=None):
        if (table, kind, column) not in have:
            out.append((severity, table, kind, column, value, to))

    stats = {name: profile(df) for name, df in tables.items()}
    keys = {name: candidate_key(df, stats=stats[name]) for name, df in tables.items()}
    for name, columns in stats.items():
        rows = next(iter(columns.values()))["rows"]
        key = keys[name]
        if key and len(key) == 1:
            add("high", name, "unique", key[0])
        add("medium", name, "rows_min", value=float(max(1, rows // 2)))
        signed = 0
        for column, s in columns.items():
            if s["numeric_text"]:
                add("medium", name, "cast_decimal", column)
            fits = (
                is_numeric(s["type"]) and s["filled"] and s["min"] >= 0 and s["distinct"] > 2
                and not _names_a_key(column, key[0] if key else None)
                and any(m in column.lower() for m in MAGNITUDE_NAMES)
            )
            if fits and (signs is None or signed < signs):
                signed += 1
                add("low", name, "non_negative", column)
    pairs = [
        ((a, column), (b, key[0]))
        for a, columns in stats.items() for b, key in keys.items() for column in columns
        if a != b and key and len(key) == 1 and _stem(column) == _stem(key[0]) and columns[column]["type"] == stats[b][key[0]]["type"]
    ]
    _, met = column_facts(tables, pairs)
    for pair in pairs:
        r = met.get(pair)  # no value in common
        if r and r.filled and r.found_rows > 0.95 * r.filled:
            (a, column), (b, key) = pair
            add("high", a, "reference", column, to=f"{b}.{key}")
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        out, "severity string, table_name string, rule string, column_name string, value double, to string"
    )


def _stem(column: str) -> str:
    """Column name without a one-letter table prefix (`o_custkey` -> `custkey`)."""
    return re.sub(r"^[a-z]{1,2}_", "", column.lower())


def starter_rules(df: DataFrame, name: str, kpis: int | None = None) -> DataFrame:
    """First rules and KPIs for a table nobody has described yet; `kpis` bounds the KPIs for display."""
    stats = profile(df)
    rows = next(iter(stats.values()))["rows"]
    likely = [
        c for c, s in stats.items()
        if s["filled"] == rows and s["type"] in (*INTEGERS, "string") and s["distinct"] >= rows * (1 - SKETCH_ERROR)
    ]
    key = next(iter(first_unique(df, [[c] for c in likely], rows) or []), None)
    out = [("rule", "rows_min", None, float(max(1, rows // 2)))]
    found = [("kpi", "count", None, None)]
    for column, s in stats.items():
        if s["filled"] == rows:
            out.append(("rule", "not_null", column, None))
            if column == key:
                out.append(("rule", "unique", column, None))
        if is_numeric(s["type"]) and s["filled"] and column != key:
            found.append(("kpi", "sum", column, None))
            if s["min"] >= 0:
                out.append(("rule", "non_negative", column, None))
    rows_out = [(name, *r) for r in [*out, *found[:kpis]]]
    return df.sparkSession.createDataFrame(
        rows_out, "table_name string, item string, kind string, column_name string, value double"
    )


def relation_integrity(tables: Mapping[str, DataFrame], relations: Sequence[Mapping]) -> DataFrame:
    """Rows, orphans and blanks per relation, and repeated keys on its one side."""
    parts = []
    for rel in relations:
        many, one = tables[rel["from_table"]], tables[rel["to_table"]]
        per_key = many.groupBy(F.col(rel["from_column"]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        side = (
            one.groupBy(F.col(rel["to_column"]).alias("k2"))
            .agg(F.count(F.lit(1)).alias("m"))
            .where("k2 is not null")
        )
        missing = F.col("k").isNotNull() & F.col("k2").isNull()
        parts.append(
            per_key.join(side, F.col("k") == F.col("k2"), "full_outer")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("orphans"),
                F.coalesce(F.sum(F.when(F.col("k").isNull() & F.col("n").isNotNull(), F.col("n"))), F.lit(0)).alias("blanks"),
                F.count_if(F.col("m") > 1).alias("repeated_keys"),
            )
            .select(F.lit(rel["name"]).alias("relation"), "*")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("rows >= 5")


def _family(kind: str) -> str:
    if is_numeric(kind):
        return "number"
    return "date" if kind in DATES else kind


def relation_preconditions(tables: Mapping[str, DataFrame], relations: Sequence[Mapping]) -> DataFrame:
    """Can each relation be declared: ends, types, unique one side, one active.

    Name and type checks read schemas only; the data part counts keys on the
    one side.
    """
    spark = next(iter(tables.values())).sparkSession
    parts, active_pairs = [], {}
    for rel in relations:
        a, b = tables.get(rel["from_table"]), tables.get(rel["to_table"])
        ends = bool(a and b and rel["from_column"] in a.columns and rel["to_column"] in b.columns)
        pair = tuple(sorted((rel["from_table"], rel["to_table"])))
        lone = True
        if rel.get("active", True):
            lone = pair not in active_pairs
            active_pairs.setdefault(pair, rel["name"])
        typed = ends and _family(dict(a.dtypes)[rel["from_column"]]) == _family(dict(b.dtypes)[rel["to_column"]])
        if ends:
            keys = b.groupBy(F.col(rel["to_column"]).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
                F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated"),
                F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("blanks"),
            )
        else:
            keys = spark.range(1).select(F.lit(None).cast("bigint").alias("repeated"), F.lit(None).cast("bigint").alias("blanks"))
        parts.append(
            keys.select(
                F.lit(rel["name"]).alias("relation"),
                F.lit(ends).alias("ends_exist"),
                F.lit(typed).alias("types_match"),
                (F.coalesce(F.col("repeated"), F.lit(1)) == 0).alias("one_side_unique"),
                (F.coalesce(F.col("blanks"), F.lit(1)) == 0).alias("one_side_filled"),
                F.lit(lone).alias("only_active"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def infer_relations(tables: Mapping[str, DataFrame], threshold: float = 0.9) -> DataFrame:
    """Many-to-one relations proven by values, proposed by names.

    A pair of columns is a candidate when the names match (table prefixes
    aside) or the column is named after the other table, and one side is
    unique.  It stays when `threshold` of the many side's DISTINCT values exist
    on the one side.  One relation per table pair, the first in column order;
    two unique sides of equal size are reported as ambiguous.  Names and types
    propose from the schemas; one job measures all that is proposed.
    """
    named = []
    for a, b in combinations(tables, 2):
        for ca, ka in tables[a].dtypes:
            for cb, kb in tables[b].dtypes:
                if _family(ka) != _family(kb) or ka in ("double", "float") or ka.startswith(NESTED):
                    continue
                by_table = re.sub(r"(id|key|code)$", "", _stem(ca)) == b or re.sub(r"(id|key|code)$", "", _stem(cb)) == a
                if _stem(ca) == _stem(cb) or by_table:
                    named.append(((a, ca), (b, cb)))
    own, met = column_facts(tables, [*named, *[(b, a) for a, b in named]])
    kept, ambiguous, used = [], [], set()
    kinds = {(t, c): k for t, df in tables.items() for c, k in df.dtypes}

    def one_side(end):
        r = own.get(end)
        return bool(r) and r.rows == r.filled == r.values and kinds[end] in KEY_TYPES

    for a, b in named:
        if a not in own or b not in own:  # an empty table
            continue
        if one_side(a) and one_side(b) and own[a].rows == own[b].rows:
            ambiguous.append((*a, *b, "ambiguous", None))
            continue
        if one_side(b) and (not one_side(a) or own[a].rows > own[b].rows):
            many, one = a, b
        elif one_side(a):
            many, one = b, a
        else:
            continue
        pair = frozenset((many[0], one[0]))
        r = met.get((many, one))
        if pair not in used and r and r.found >= threshold * r.values:
            used.add(pair)
            kept.append((*many, *one, "many_to_one", round(r.found / r.values, 6)))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        [*kept, *ambiguous],
        "from_table string, from_column string, to_table string, to_column string, kind string, share double",
    )


def health(tables: Mapping[str, DataFrame], quality_score: float, declared_tables: Sequence[str]) -> DataFrame:
    """Measured scores: how well typed and keyed the data is, how well watched."""
    stats = {n: profile(df) for n, df in tables.items()}
    columns = sum(len(s) for s in stats.values())
    mistyped = sum(v["numeric_text"] for s in stats.values() for v in s.values())
    keyed = sum(candidate_key(df, stats=stats[n]) is not None for n, df in tables.items())
    data = 100 - 2 * 100 * mistyped / columns - (0 if keyed == len(tables) else 15)
    covered = 100 * sum(n in set(declared_tables) for n in tables) / len(tables)
    quality = 0.7 * quality_score + 0.3 * covered
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        [("data", round(max(0.0, data), 1)), ("quality", round(quality, 1))], "area string, score double"
    )
