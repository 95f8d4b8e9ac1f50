"""The numbered operators on the given tables: each query renames columns, calls its operator and shapes the contract's result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .chat import format_conversations
from .decontaminate import shared_passages
from .language_model import score_texts
from .language import identify_language
from .packing import pack_sequences
from .repeats import remove_repeats
from .resample import resample_items
from .secret_scan import KINDS, scan_secrets
from .similar import similar_groups
from .toxicity import classify_toxicity
from .url_filter import filter_urls
from .vector_codes import encode_vectors
from .vectors import similar_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as item records: (SKU, Product_Name) for (doc_id, text)."""
    return as_items(table(spark, sf_dir, "documents"))


def as_items(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("SKU"), F.col("text").alias("Product_Name"))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)), F.lit(0))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_score")
def op1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), fold("SKU", 5) != 1).withColumnRenamed("SKU", "doc_id")


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k, *_ in KINDS]
    base = F.filter("spans", lambda s: s["kind_rank"] < len(KINDS))
    return found.select(
        F.col("SKU").alias("doc_id"), *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans")
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_items(documents(spark, sf_dir)))


def pack_items(items: DataFrame) -> DataFrame:
    return pack_sequences(items, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.col("SKU").alias("doc_id"), "start", "length", F.crc32("token_ids").alias("ids_crc32"), F.col("item_tokens").alias("doc_tokens"),
        "sequence_id", "offset",
    )


def language_training(docs: DataFrame) -> DataFrame:
    """Texts and languages of the fold that may be read."""
    return docs.where(fold("doc_id", 4) != 2).select(F.col("text").alias("Product_Name"), F.col("lang").alias("language"))


def language_items(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(F.struct(*keep).alias("SKU"), F.col("text").alias("Product_Name"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_language(language_items(docs, ["doc_id"]), language_training(docs)).select("SKU.*", "lang_pred", "score")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


SQL_OP7 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, w, least(len(w), 10) AS m
    FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, list_slice(w, s, s + m - 1) AS span FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM b)),
dw AS (SELECT doc_id, s, m, list_slice(w, s, s + m - 1) AS span
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT doc_id, s, m, item_id FROM dw JOIN bw USING (m, span)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query("op7_decontamination", SQL_OP7)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_passages(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("SKU").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_OP4 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM t AS a JOIN t AS b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, a.n, b.doc_id, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) AS c ON c.id = s.doc_id
"""


@query("op4_similar", SQL_OP4)
def op4_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir)).withColumnRenamed("SKU", "doc_id")


# The rules of the url contract.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op8_urls")
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, rounds=None)


SQL_OP10 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, l, count(*) AS n_copies FROM c GROUP BY l)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_copies,
    array_to_string(list_transform(l, lambda e: '<|im_start|>' || coalesce(e.r, 'unknown') || chr(10) || coalesce(e.x, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS b WHERE len(b.l) > len(u.l) AND b.l[1:len(u.l)] = u.l)
"""


@query("op10_chat", SQL_OP10)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


@query("op6_vectors")
def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("SKU"), F.col("label").alias("Category"), F.col("embedding").alias("features"))
    return similar_vectors(items).withColumnRenamed("SKU", "vec_id")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "SKU")
    return classify_toxicity(documents(spark, sf_dir), labels).withColumnRenamed("SKU", "doc_id")


def as_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("SKU"), F.col("label").alias("Category"), F.col("embedding").alias("features"))


def codes_sql(rounds: int = 2) -> str:
    """Every part against every entry, spelled out for each round."""
    near = "(SELECT id, p, arg_min(e, [d, e]) AS e, min(d) AS d FROM (SELECT q.id, q.p, b.e, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))) AS d FROM q JOIN b{} AS b USING (p)) GROUP BY id, p)"
    steps = []
    for r in range(rounds):
        steps.append(f"""n{r} AS {near.format(r)},
m{r} AS (SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT n.p, n.e, i, CAST(floor(sum(q.x[i]) / count(*)) AS BIGINT) AS s FROM n{r} AS n JOIN q USING (id, p), (SELECT unnest(range(1, w + 1)) AS i FROM k) GROUP BY n.p, n.e, i) GROUP BY p, e),
b{r + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} AS b LEFT JOIN m{r} AS m USING (p, e))""")
    return f"""
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST) AS id
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
k AS (SELECT CAST(max(len(x)) / 16 AS BIGINT) AS w FROM v),
q AS (SELECT id, p, list_slice(x, p * w + 1, p * w + w) AS x FROM v, k, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, id - 1 AS e, x FROM q WHERE id <= 64),
{", ".join(steps)},
f AS {near.format(rounds)},
c AS (SELECT id, array_to_string(list(lpad(lower(to_hex(e)), 2, '0') ORDER BY p), '') AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY id),
h AS (SELECT sha256(array_to_string(list(array_to_string(x, ',') ORDER BY p, e), ',')) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (id), h
"""


@query("op11_codes", codes_sql())
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_vectors(as_vectors(table(spark, sf_dir, "embeddings")))
    text = ",".join(str(x) for book in found.codebooks for entry in book for x in entry)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    digest = F.lit(hashlib.sha256(text.encode()).hexdigest())
    return found.codes.select(F.col("SKU").alias("vec_id"), code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


# Words and their pairs are counted whole; crc32 runs bit by bit over the UTF-8 bytes of each distinct feature.
SQL_OP13 = r"""
WITH x AS (
    SELECT 'd' AS side, row_number() OVER () AS i, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (
    SELECT side, i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (
    SELECT side, i, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) ELSE [] END)) AS g FROM w),
n AS (SELECT side, i, g, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT DISTINCT g FROM n),
y AS (SELECT g, list_transform(range(length(hex(g)) // 2), lambda p: CAST(('0x' || substr(hex(g), CAST(2 * p + 1 AS BIGINT), 2)) AS BIGINT)) AS y FROM g),
c AS (
    SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(y, lambda b: list_transform(range(8), lambda k: (b >> CAST(k AS BIGINT)) & 1)))),
        lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295) % 10000 AS bucket FROM y),
k AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n JOIN c USING (g) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM k),
h AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM k, a),
p AS (SELECT i, sum(n) AS n_features, sum(n * gain) AS total FROM n JOIN c USING (g) JOIN h USING (bucket) WHERE side = 'd' GROUP BY i),
q AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
        CAST(coalesce((total - ((total % n_features) + n_features) % n_features) / n_features, 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM w LEFT JOIN p USING (i) WHERE side = 'd'),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM q),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM z WHERE n_words >= 20) THEN place END AS rank FROM r
"""


@query("op13_resample", SQL_OP13)
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("text"), target_text="text")
    return out.withColumnRenamed("SKU", "doc_id")


SQL_OP12 = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, b[s:s + 99] AS x FROM (SELECT *, unnest(range(1, n - 98)) AS s FROM t WHERE n >= 100)),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM d),
i AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g) GROUP BY doc_id, k),
p AS (
    SELECT doc_id, lag(e, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS f, a - 1 AS u FROM i UNION ALL SELECT doc_id, max(e), NULL FROM i GROUP BY doc_id),
h AS (SELECT doc_id, unhex(string_agg(hex(b[f:coalesce(u, n)]), '' ORDER BY f)) AS kept FROM p JOIN t USING (doc_id) WHERE f <= coalesce(u, n) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM i GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(CASE WHEN n_spans IS NULL THEN b ELSE coalesce(kept, encode('')) END) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)
"""


@query("op12_repeats", SQL_OP12)
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("SKU").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
