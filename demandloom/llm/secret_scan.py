"""Secrets in free text: fixed patterns, and runs of characters that a battery of randomness tests cannot tell from a random key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.checkpoints import work_dir

# The patterns of the base kinds, in their order, with the group that is measured and its least length.
KINDS = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from narrow to wide: name, pattern of the whole run, alphabet in the order of its values.
ENCODINGS = (
    ("hex", "[0-9a-f]+", DIGITS + LOWER[:6]),
    ("hex_upper", "[0-9A-F]+", DIGITS + UPPER[:6]),
    ("base32", "[A-Z2-7]+", UPPER + DIGITS[2:8]),
    ("base36", "[0-9a-z]+", DIGITS + LOWER),
    ("base36_upper", "[0-9A-Z]+", DIGITS + UPPER),
    ("base62", "[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("base64", "[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", "[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
)
BINS = 1000
MARK = "[SECRET]"
SPANS = "array<struct<start:int,end:int,body:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end (code points, end exclusive) and measured group of all matches, leftmost first and without overlap.

    The pieces between the matches and the matches themselves give the positions; both come from the same scan rule.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), body.alias("body"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["body"].alias("body"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal value exceeds ``z`` (absolute error below 1e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def encoding_of(body: Column) -> Column:
    """The narrowest encoding whose alphabet holds the run, if it has both a digit and a letter."""
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return F.coalesce(*[F.when(mixed & body.rlike(f"^{p}$"), F.lit(name)) for name, p, _ in ENCODINGS])


def pieces_of(run: Column) -> Column:
    """The run itself and its pieces of 20 or more characters between slashes and, if no encoding holds the run, between the
    marks of either wide encoding; each with its inferred encoding, none twice.
    """
    body = run["body"]

    def between(marks: str) -> Column:
        found = matches(body, f"[^{marks}]{{{LEAST},}}")
        return F.transform(found, lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["body"].alias("body")))

    none = F.array().cast(SPANS)
    whole = F.array(F.struct(run["start"].alias("start"), run["end"].alias("end"), body.alias("body")))
    cut = F.when(body.contains("/"), between("/")).otherwise(none)
    both = F.when(body.rlike("[/+]") & body.rlike("[_-]"), F.concat(between("/+"), between("_-"), between("/+_-"))).otherwise(none)
    every = F.array_distinct(F.concat(whole, cut, both))
    return F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), encoding_of(s["body"]).alias("encoding")))


def battery(run: Column) -> Column:
    """Bonferroni-combined p-value of three tests of the symbols of ``run`` (fields ``body``, ``encoding``) against a uniform source.

    Chi-squared of the symbol counts (with the exact variance for its length), runs of the lower and upper half of the alphabet,
    and lag-one correlation of the symbol values.
    """
    alphabet = F.coalesce(*[F.when(run["encoding"] == name, F.lit(a)) for name, _, a in ENCODINGS])
    symbols = F.transform(F.split(run["body"], ""), lambda c: F.position(c, alphabet) - 1)
    n, k = F.length(run["body"]).cast("double"), F.length(alphabet).cast("double")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def tests(s: Column) -> Column:
        squares = total(F.transform(F.array_distinct(s), lambda v: F.pow(F.size(F.filter(s, lambda x: x == v)), F.lit(2.0))))
        df = k - 1
        chi = (squares * k / n - n - df) / F.sqrt(2 * df * (n - 1) / n)
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(s, lambda x: x * 2 >= k)).cast("double")
        low = n - high
        changes = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k))) + 1.0
        expected = 2 * high * low / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, (changes - expected) / F.sqrt(spread)).otherwise(F.lit(99.0))
        mean = total(F.transform(s, lambda x: x.cast("double"))) / n
        power = total(F.transform(s, lambda x: (x - mean) * (x - mean)))
        lag = F.when(power > 0, total(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))) / power).otherwise(F.lit(1.0))
        serial = (lag + 1 / n) * F.sqrt(n)
        worst = F.least(upper_tail(chi), 2 * upper_tail(F.abs(runs)), 2 * upper_tail(F.abs(serial)))
        return F.least(3 * worst, F.lit(1.0))

    return F.element_at(F.transform(F.array(symbols), tests), 1)


def scan_secrets(records: DataFrame, key: str = "SKU", text: str = "Product_Name", false_discovery: float = 0.05, keep_text: bool = False) -> DataFrame:
    """Secrets in every item text: (key, ``spans``), and with ``keep_text`` also ``redacted``.

    ``spans`` is an array of (start, kind_rank, kind, end) in code points, end exclusive, ordered by start and kind. The base
    kinds are ``assign``, ``access`` and ``hex``. Kind ``random`` adds runs of 20 or more encoded characters that overlap no base
    span, and their pieces of that length between slashes (in a run that no encoding holds, also between the marks foreign to
    one of the wide encodings): the encoding is inferred from the characters, the battery gives each run a p-value against a uniform source, and
    Benjamini-Hochberg within each encoding and length class (powers of two) dismisses runs as ordinary text while at most a
    share ``false_discovery`` of the dismissed are random; the others are secrets (of runs and pieces that overlap, all that stay). p-values are rounded up to thousandths, so the
    procedure needs only counts per class and thousandth, over all rows. ``redacted`` is the text with each union of
    overlapping spans replaced by a mark. A null text counts as empty and has no spans; its redacted text stays null. Null keys,
    repeated rows and texts of any length are scanned like any other; an empty table gives no rows; other columns are dropped.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rank = {name: i for i, (name, *_) in enumerate(KINDS)}

    def base(name: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(matches(value, pattern, group), lambda s: F.length(s["body"]) >= least)
        return F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank[name]).alias("kind_rank"), F.lit(name).alias("kind"), s["end"].alias("end")
        ))

    runs = F.flatten(F.transform(matches(value, CANDIDATE), pieces_of))
    found = records.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.array_sort(F.concat(*[base(*k) for k in KINDS])).alias("_base"), runs.alias("_runs")
    )
    free = F.filter("_runs", lambda r: r["encoding"].isNotNull() & ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    found = found.withColumn("_tested", F.transform(free, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"),
        F.concat_ws(":", r["encoding"], F.floor(F.log2((r["end"] - r["start"]).cast("double"))).cast("string")).alias("class"),
        F.ceil(battery(r) * BINS).cast("int").alias("bin"),
    ))).drop("_runs", *([] if keep_text else ["_text"]))
    path = f"{work_dir(records.sparkSession)}/runs"
    found.write.option("compression", "zstd").parquet(path)
    found = records.sparkSession.read.schema(found.schema).parquet(path)
    dismissed = F.create_map(*reduce(lambda a, x: [*a, F.lit(x["class"]), F.lit(x["bin"])], dismissal_limits(found, false_discovery), [F.lit(""), F.lit(0)]))
    secret = F.filter("_tested", lambda r: r["bin"] > F.coalesce(F.try_element_at(dismissed, r["class"]), F.lit(0)))
    added = F.transform(secret, lambda r: F.struct(
        r["start"].alias("start"), F.lit(len(KINDS)).alias("kind_rank"), F.lit(RANDOM).alias("kind"), r["end"].alias("end")
    ))
    spans = F.array_sort(F.concat(F.col("_base"), added))
    out = found.select(F.col("_key").alias(key), spans.alias("spans"), *(["_text"] if keep_text else []))
    if keep_text:
        out = out.withColumn("redacted", redact(F.col("_text"), F.col("spans"))).drop("_text")
    return out


def dismissal_limits(found: DataFrame, q: float) -> list:
    """Per class, the largest p-value bin that Benjamini-Hochberg rejects; at most one row per encoding and power of two."""
    bins = found.select(F.explode("_tested").alias("r")).groupBy("r.class", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    ranked = bins.selectExpr("class", "bin", "sum(n) OVER (PARTITION BY class ORDER BY bin) AS below", "sum(n) OVER (PARTITION BY class) AS m")
    return ranked.where(F.col("bin") * F.col("m") <= q * BINS * F.col("below")).groupBy("class").agg(F.max("bin").alias("bin")).collect()


def redact(text: Column, spans: Column) -> Column:
    """The text with every union of overlapping spans replaced by a mark."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["pos"]
        gap = F.concat(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(MARK))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(apart, F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    whole = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
