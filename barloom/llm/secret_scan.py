"""Secret scan in SQL functions: three fixed forms, and Markov models of random strings and ordinary identifiers.

The forms find assignments, access keys and hexadecimal strings. They also label the samples: the values they find are
random strings, the runs of identifier characters outside them that hold a letter are ordinary. Two first-order Markov
models of characters are counted on all distinct labelled strings. A further run of 16 or more characters with a
letter is a secret if the log-likelihood ratio of the models is high enough, in sum and for each transition. The random
model is half the counts and half the uniform distribution, the ordinary one nearly its counts, so neither depends on
the size of the sample: with few random strings the first is near uniform. The models are at most 128 x 128 integers (thousandths of a
nat), a literal of the scoring plan; nothing is joined, and rows never leave the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three forms, each character class written out so that letters fold in ASCII alone.
FORMS: dict[str, str] = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Characters of the value of an assignment, at least.
ASSIGNED = 6
#: The kind of span that the models add, and what they look at.
ADDED = "random"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{6,}"
SYMBOLS = 66
#: Weights of the counts in the two models; the rest is uniform over the symbols.
RANDOM_WEIGHT, ORDINARY_WEIGHT = 0.5, 0.99
#: Taken off each count of the ordinary model, so that a secret that no form names does not vouch for itself.
DISCOUNT = 5
#: Log-likelihood ratio that makes a secret, in thousandths of a nat: in sum, and for each transition.
TOTAL, MEAN = 14_000, 1_000
#: Matches whose places are summed in one fold; longer lists are summed block by block.
BLOCK = 256


def _running_spans(steps: Column) -> Column:
    """Array of (start, stop) for an array of (gap, size): each size begins after its gap and all before."""
    place = "struct<at:bigint,spans:array<struct<start:bigint,stop:bigint>>>"
    offsets = "struct<at:bigint,all:array<bigint>>"
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda t, s: t + s["gap"] + s["size"])

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + s["size"]).alias("stop"))
        return F.struct((start + s["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def fold(part: Column, at: Column) -> Column:
        zero = F.struct(at.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")).cast(place)
        return F.aggregate(part, zero, step, lambda acc: acc["spans"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")).cast(offsets)
    before = F.aggregate(
        F.transform(blocks, total), zero, lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"]
    )
    long_list = F.flatten(F.zip_with(blocks, before, fold))
    return F.when(F.size(steps) <= BLOCK, fold(steps, F.lit(0))).otherwise(long_list)


def _located(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """``rows`` (text, column: its matches of ``pattern``) with ``column``_at: (start, stop) of each match."""
    gaps = F.split("text", pattern, -1)
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(column)), F.col(column), lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"))
    )
    none = F.array().cast("array<struct<gap:bigint,size:bigint>>")
    rows = rows.withColumn(f"{column}_steps", F.when(F.size(column) > 0, steps).otherwise(none))
    return rows.withColumn(f"{column}_at", _running_spans(F.col(f"{column}_steps"))).drop(f"{column}_steps")


def _matches(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns, text (null: empty), the matches of the three forms and the values of the assignments."""
    rows = docs.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(*keys, "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in FORMS.items()])
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(FORMS["assign"]), F.lit(2))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("values", values)


def _good(values: Column) -> Column:
    return F.filter(values, lambda v: F.length(v) >= ASSIGNED)


def labelled_strings(docs: DataFrame) -> DataFrame:
    """Distinct (string, random) of the texts of ``docs``: values of the forms, and other runs that hold a letter."""
    rows = _matches(docs)
    rest = F.col("text")
    for kind, pattern in FORMS.items():
        rest = F.when(F.size(kind) > 0, F.regexp_replace(rest, pattern, " ")).otherwise(rest)
    random = F.transform(F.concat(_good(F.col("values")), F.col("access"), F.col("hex")), lambda v: F.struct(v.alias("string"), F.lit(True).alias("random")))
    plain = F.filter(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)), lambda v: v.rlike("[A-Za-z]"))
    plain = F.transform(plain, lambda v: F.struct(v.alias("string"), F.lit(False).alias("random")))
    return rows.select(F.explode(F.concat(random, plain)).alias("s")).select("s.string", "s.random").distinct()


def transitions(strings: DataFrame) -> DataFrame:
    """Rows (random, pair, n): how often a pair of neighbouring characters is in the strings of each label."""
    pairs = F.regexp_extract_all("string", F.lit("(?=(..))"), F.lit(1))
    return strings.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))


def _ratio(pair: str, n: dict[str, dict], first: dict[str, dict]) -> int:
    p = []
    for random, weight, less in ((True, RANDOM_WEIGHT, 0), (False, ORDINARY_WEIGHT, DISCOUNT)):
        of = first[random].get(pair[0], 0)
        counted = weight * (max(n[random].get(pair, 0) - less, 0) / of) if of else weight / SYMBOLS
        p.append(counted + (1 - weight) / SYMBOLS)
    return math.floor(1000 * math.log(p[0] / p[1]) + 0.5)


def log_ratios(counts: DataFrame) -> list[int]:
    """log P(b | a) under the random model over that under the ordinary one, in thousandths, at 128 * a + b.

    At most 2 * 66 * 66 counts come to the driver.
    """
    n: dict = {True: {}, False: {}}
    first: dict = {True: {}, False: {}}
    for r in counts.collect():
        n[r["random"]][r["pair"]] = r["n"]
        first[r["random"]][r["pair"][0]] = first[r["random"]].get(r["pair"][0], 0) + r["n"]
    return [_ratio(chr(a) + chr(b), n, first) for a in range(128) for b in range(128)]


def _score(string: Column, ratios: Column) -> Column:
    pairs = F.regexp_extract_all(string, F.lit("(?=(..))"), F.lit(1))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda t, p: t + F.get(ratios, F.ascii(p) * 128 + F.ascii(F.substring(p, 2, 1))))


def scan(docs: DataFrame, ratios: list[int] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts of the forms and all spans.

    ``ratios`` are of log_ratios(); without them the models are learned from ``docs`` itself, all of it. Columns:
    doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (of the spans of the forms), spans: ``kind:start:end`` by
    start, then kind (assign, access, hex, random), in code points, end exclusive. A run that the models take is left
    out where it overlaps a span of a form. Null and empty texts have no spans, null doc_ids and repeated rows keep
    their rows, other columns are unread, an empty table gives an empty one. Texts of any length are read whole.
    """
    if ratios is None:
        ratios = log_ratios(transitions(labelled_strings(docs)))
    rows = _matches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").withColumn("runs", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    for column, pattern in (*FORMS.items(), ("runs", CANDIDATE)):
        rows = _located(rows, column, pattern)
    named = []
    for order, kind in enumerate(FORMS):
        at = F.col(f"{kind}_at")
        if kind == "assign":
            at = F.filter(F.zip_with(at, F.col("values"), lambda s, v: F.when(F.length(v) >= ASSIGNED, s)), lambda s: s.isNotNull())
        named.append(_named(at, order, kind))
    rows = rows.withColumn("base", F.array_sort(F.concat(*named)))
    table = F.array(*[F.lit(r) for r in ratios])
    secret = lambda s, v: F.when(v.rlike("[A-Za-z]") & (_score(v, table) >= TOTAL) & (_score(v, table) >= MEAN * (F.length(v) - 1)), s)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    found = F.filter(F.zip_with("runs_at", "runs", secret), lambda s: s.isNotNull())
    rows = rows.withColumn("added", F.filter(found, free))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in FORMS],
        F.size("added").cast("long").alias(f"n_{ADDED}"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", _named(F.col("added"), len(FORMS), ADDED)))).alias("spans"),
    )


def _named(at: Column, order: int, kind: str) -> Column:
    fields = lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))
    return F.transform(at, fields)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_sql() -> str:
    """What scan() computes over the table ``documents``, models included, for DuckDB."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    forms = {k: quote(p) for k, p in FORMS.items()}
    rest = "text"
    for p in forms.values():
        rest = f"regexp_replace({rest}, {p}, ' ', 'g')"

    def at(pattern: str) -> str:
        m, g = f"regexp_extract_all(text, {pattern})", f"string_split_regex(text, {pattern})"
        return f"""list_transform(range(1, len({m}) + 1), lambda i: struct_pack(
        start := CAST(coalesce(list_sum(list_transform({g}[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: len(x))), 0) AS BIGINT), match := {m}[i]))"""

    kinds = " UNION ALL ".join(f"SELECT r, {o} AS o, '{k}' AS kind, unnest({at(p)}) AS s FROM docs" for o, (k, p) in enumerate(forms.items()))
    kept = f"(kind <> 'assign' OR len(regexp_extract(s.match, {forms['assign']}, 2)) >= {ASSIGNED})"
    model = lambda label, weight, less: f"coalesce({weight} * (greatest(coalesce({label}.n, 0) - {less}, 0) / {label}_of.n), {weight} / {SYMBOLS}) + (1 - {weight}) / {SYMBOLS}"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({kinds}),
base AS (SELECT r, o, kind, s.start AS start, s.start + len(s.match) AS stop, s.match AS match FROM found WHERE {kept}),
strings AS (
  SELECT DISTINCT CASE WHEN kind = 'assign' THEN regexp_extract(match, {forms['assign']}, 2) ELSE match END AS string, true AS random FROM base
  UNION
  SELECT * FROM (SELECT unnest(regexp_extract_all({rest}, {quote(IDENTIFIER)})) AS string, false AS random FROM docs) WHERE regexp_matches(string, '[A-Za-z]')),
pairs AS (
  SELECT random, pair, count(*)::DOUBLE AS n FROM (SELECT random, unnest(list_transform(range(1, len(string)), lambda i: string[i : i + 1])) AS pair FROM strings) GROUP BY random, pair),
firsts AS (SELECT random, pair[1:1] AS a, sum(n) AS n FROM pairs GROUP BY random, a),
runs AS (SELECT row_number() OVER () AS k, r, s.start AS start, s.match AS string FROM (SELECT r, unnest({at(quote(CANDIDATE))}) AS s FROM docs)),
run_pairs AS (SELECT k, unnest(list_transform(range(1, len(string)), lambda i: string[i : i + 1])) AS pair FROM runs),
scores AS (
  SELECT k, sum(CAST(floor(1000 * ln(({model('x', RANDOM_WEIGHT, 0)}) / ({model('y', ORDINARY_WEIGHT, DISCOUNT)})) + 0.5) AS BIGINT)) AS score
  FROM run_pairs p
  LEFT JOIN pairs x ON x.random AND x.pair = p.pair LEFT JOIN firsts x_of ON x_of.random AND x_of.a = p.pair[1:1]
  LEFT JOIN pairs y ON NOT y.random AND y.pair = p.pair LEFT JOIN firsts y_of ON NOT y_of.random AND y_of.a = p.pair[1:1]
  GROUP BY k),
added AS (
  SELECT r, {len(FORMS)} AS o, '{ADDED}' AS kind, start, start + len(string) AS stop FROM runs JOIN scores USING (k)
  WHERE regexp_matches(string, '[A-Za-z]') AND score >= {TOTAL} AND score >= {MEAN} * (len(string) - 1)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = runs.r AND b.start < runs.start + len(string) AND runs.start < b.stop)),
spans AS (SELECT r, o, kind, start, stop FROM base UNION ALL SELECT * FROM added),
per AS (
  SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*FORMS, ADDED))},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (kind <> '{ADDED}') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*FORMS, ADDED))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (r)
"""
