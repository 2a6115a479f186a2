"""The library's operators applied to the test tables, each with the same query in SQL where SQL has it.

``CATALOG`` maps a name to a function of ``(spark, sf_dir)`` and a DuckDB statement or ``None``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import classify, consolidate, conversations, dedup, overlap, relational, sampling, training, validate
from ..operators.durable import spread

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        CATALOG[function.__name__] = (lambda spark, sf_dir: function(Tables(spark, sf_dir)), sql)
        return function

    return register


# Relational core: projection, predicates, joins, aggregation, windows, sets.


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 45 AND NOT (l_returnflag = 'R') AND l_discount <> 0.0")
def filter_select(t):
    kept = t.lineitem.where((F.col("l_quantity") >= 45) & ~(F.col("l_returnflag") == "R") & (F.col("l_discount") != 0.0))
    return kept.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS missing FROM events")
def nested_field(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNull().alias("missing"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents")
def flat_map_words(t):
    return t.documents.select("doc_id", F.explode(text.words(F.col("text"))).alias("word"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS price, count(DISTINCT l_partkey) AS parts, max(l_shipdate) AS last FROM lineitem GROUP BY ALL")
def group_aggregate(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.count_distinct("l_partkey").alias("parts"), F.max("l_shipdate").alias("last"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def group_having(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def group_list(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total, max(o_totalprice) AS most FROM orders")
def reduce_global(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"), F.max("o_totalprice").alias("most"))


@query("SELECT count(*) AS n FROM documents WHERE doc_id < 0")
def count_empty(t):
    return t.documents.where("doc_id < 0").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def deduplicate_by_key(t):
    return relational.deduplicate(t.documents.select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_version(t):
    return relational.latest(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def join_inner(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, d.n_chars, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left_default(t):
    defaults = t.documents.select("doc_id", "n_chars", F.lit(-1).alias("quality"))
    return relational.combined_join(defaults, t.labels.select("doc_id", "quality"), ["doc_id"], "left")


@query("SELECT o.o_orderkey, l.l_linenumber, c.c_name FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def join_duplicates(t):
    customers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "c_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(t):
    return classify.resume(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 2")
def take_per_group(t):
    return relational.take_per_group(t.documents.select("source", "doc_id"), 2, ["source"], [F.col("doc_id")])


@query("SELECT source, floor((r - 1) / 7)::BIGINT AS batch, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY ALL")
def window_batches(t):
    batched = relational.count_batches(t.documents.select("source", "doc_id"), 7, ["source"], [F.col("doc_id")])
    return batched.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, n_chars::DOUBLE AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, r, 0::BIGINT AS batch, n AS total FROM s WHERE r = 1 UNION ALL
SELECT s.source, s.r, CASE WHEN f.total + s.n >= 10000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.total + s.n >= 10000 THEN s.n ELSE f.total + s.n END FROM f JOIN s ON s.source = f.source AND s.r = f.r + 1)
SELECT source, batch, count(*) AS items, max(total) AS total FROM f GROUP BY source, batch""")
def window_by_size(t):
    return relational.size_batches(t.documents.select("source", "doc_id", "n_chars"), 10000, "n_chars", ["source"], ["doc_id"])


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, event_id, r, 0::BIGINT AS batch, v AS total FROM s WHERE r = 1 UNION ALL
SELECT s.user_id, s.event_id, s.r, CASE WHEN f.total + s.v >= 100 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.total + s.v >= 100 THEN s.v ELSE f.total + s.v END FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1)
SELECT user_id, event_id, batch FROM f""")
def window_by_fold(t):
    def fold(state, row):
        total = (state or 0.0) + row["value"]
        return total < 100, total

    return relational.fold_batches(t.events.select("user_id", "event_id", "value"), fold, ["user_id"], ["event_id"]).select("user_id", "event_id", "batch")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders")
def reshard(t):
    return relational.reshard(t.orders, 5).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def set_union(t):
    return t.customer.select("c_custkey").union(t.supplier.select("s_suppkey")).distinct()


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_intersect(t):
    return t.orders.select("o_custkey").intersect(t.customer.where("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t):
    return t.customer.select("c_custkey").exceptAll(t.orders.select("o_custkey").distinct())


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_counts(t):
    counted = t.documents.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def paged_browse(t):
    return relational.page(t.documents.select("doc_id", "n_chars"), 10, 20, [F.col("n_chars").desc(), F.col("doc_id")])


@query("SELECT doc_id, source, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars)::BIGINT AS start FROM documents")
def prefix_offsets(t):
    return relational.prefix_sums(t.documents.select("doc_id", "source", "n_chars"), "n_chars", [F.col("doc_id")], ["source"]).select("doc_id", "source", "start")


# Text and hashes.

_PUNCTUATION = text.PUNCTUATION.replace("'", "''")
_CLEAN = f"trim(regexp_replace(translate(lower(text), '{_PUNCTUATION}', ''), '[ \\t-\\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_text(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, md5(text) AS hash, sha256(text) AS sha, strlen(text)::BIGINT AS bytes FROM documents")
def text_hashes(t):
    return t.documents.select("doc_id", F.md5("text").alias("hash"), F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"))


@query()
def arrow_hashes(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", hashing.xxh3_64("text").alias("xxh3_64"), hashing.xxh3_128("text").alias("xxh3_128"), hashing.blake2b("text").alias("blake2b"))


@query("SELECT conv_id, turn, coalesce(CASE WHEN turn > 0 THEN conv_id::VARCHAR END, md5(text)) AS id FROM conversations")
def record_ids(t):
    return t.conversations.select("conv_id", "turn", text.record_id(F.when(F.col("turn") > 0, F.col("conv_id")), F.col("text")).alias("id"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents) SELECT doc_id, i::BIGINT AS pos, array_to_string(w[i:i+3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2, 2)) AS i FROM w WHERE len(w) >= 4)")
def word_ngrams(t):
    grams = t.documents.select("doc_id", F.posexplode(text.ngrams(text.words(F.col("text")), 4, stride=1)).alias("p", "gram"))
    return grams.select("doc_id", (2 * F.col("p") + 1).cast("long").alias("pos"), "gram")


_LINES = """lines AS (SELECT doc_id, pos, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(line) - 1)::BIGINT AS b
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS pos FROM documents))"""


@query(f'WITH {_LINES} SELECT doc_id, pos, b AS "begin", (b + length(line))::BIGINT AS "end", md5(line) AS hash FROM lines WHERE line <> \'\'')
def split_paragraphs(t):
    return dedup.paragraphs(t.documents)


@query("SELECT doc_id, '__label__' || quality || ' ' || translate(text, chr(10) || chr(13), '') AS line FROM documents JOIN labels USING (doc_id)")
def training_lines(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", text.training_line(F.col("quality"), F.col("text")).alias("line"))


@query("SELECT doc_id, coalesce(length(text) >= 10 AND floor(100 * length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) / length(text)) <= 50 AND len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) >= 70 AND floor(100 * length(regexp_replace(text, '[\\p{L}\\p{N}]', '', 'g')) / length(text)) <= 50, false) AS passes FROM documents")
def encyclopedia_gate(t):
    return t.documents.select("doc_id", text.encyclopedia_gate(F.col("text")).alias("passes"))


@query("SELECT p_partkey, '.' || lower(trim(split_part(p_type, ' ', 1))) AS extension FROM part WHERE '.' || lower(trim(split_part(p_type, ' ', 1))) IN ('.standard', '.promo')")
def extension_filter(t):
    own = t.part.select("p_partkey", text.normalised_extension(F.split("p_type", " ")[0]).alias("extension"))
    return own.where(F.col("extension").isin(".standard", ".promo"))


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(n_chars, 0) >= 1500")
def length_filter(t):
    return t.documents.select("doc_id", "n_chars").where(F.coalesce("n_chars", F.lit(0)) >= 1500)


@query()
def compression_quality(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.round(classify.scorer("compression-v1")(F.col("text")), 6).alias("score"))


# Deduplication.


@query("WITH h AS (SELECT doc_id, md5(text) AS hash, count(*) OVER (PARTITION BY md5(text)) AS cnt, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical FROM documents) SELECT doc_id, cnt > 1 AND canonical <> doc_id AS exact_duplicate FROM h")
def exact_document_dedup(t):
    return dedup.exact_documents(t.documents)


_MARKED = f"{_LINES}, p AS (SELECT doc_id, b, b + length(line) AS e, count(*) OVER (PARTITION BY line) AS cnt, min(doc_id) OVER (PARTITION BY line) AS canonical FROM lines WHERE line <> '')"


@query(f'WITH {_MARKED} SELECT doc_id, b AS "begin", e::BIGINT AS "end", 1.0::DOUBLE AS score FROM p WHERE cnt > 1 AND canonical <> doc_id')
def exact_paragraph_dedup(t):
    return dedup.exact_paragraphs(t.documents)


@query("WITH c AS (SELECT count(*) AS cnt FROM documents GROUP BY text) SELECT sum(cnt)::BIGINT AS total, coalesce(sum(cnt) FILTER (cnt > 1), 0)::BIGINT AS dups, count(*) FILTER (cnt = 1) AS unique_items, count(*) FILTER (cnt > 1) AS dup_clusters FROM c")
def duplicate_counters(t):
    return dedup.duplicate_counters(dedup.hash_counts(t.documents.select("doc_id", F.md5("text").alias("hash")), "hash", "doc_id"))


def _signature_sql(permutations: int = 286, bands: int = 26, width: int = 5) -> str:
    rows = permutations // bands
    least = ", ".join("coalesce(list_min(list_transform(h, lambda x: (x * {} + {}) % {})), {})".format(*dedup.permutation(j), dedup.MODULUS, dedup.MODULUS) for j in range(permutations))
    number = " + ".join(f"coalesce(p[i + {k}], 0) * {factor}" for k, factor in enumerate(dedup.shingle_factors(width)))
    return f"""c AS (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL),
points AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ''), lambda x: unicode(x)::BIGINT) END AS p FROM c),
hashed AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN [] ELSE list_transform(range(1, greatest(len(p) - {width - 1}, 1) + 1), lambda i: ({number}) % {dedup.MODULUS}) END AS h FROM points),
sig AS (SELECT doc_id, [{least}] AS m FROM hashed),
buckets AS (SELECT doc_id, band, md5(array_to_string(m[band * {rows} + 1 : band * {rows} + {rows}], ',')) AS bucket FROM (SELECT doc_id, m, unnest(range({bands}))::BIGINT AS band FROM sig))"""


@query(f"WITH {_signature_sql()} SELECT doc_id, band, bucket FROM buckets")
def lsh_buckets(t):
    return dedup.lsh_buckets(t.documents)


@query(f"""WITH RECURSIVE {_signature_sql()},
heads AS (SELECT band, bucket, min(doc_id) AS head FROM buckets GROUP BY ALL),
stars AS (SELECT DISTINCT head AS a, doc_id AS b FROM buckets JOIN heads USING (band, bucket) WHERE doc_id <> head),
edges AS (SELECT a, b FROM stars UNION SELECT b, a FROM stars),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT node AS doc_id, component, component <> node AS fuzzy_duplicate FROM comp""")
def fuzzy_document_dedup(t):
    return dedup.fuzzy_documents(t.documents)


# Decontamination.

_GRAMS = lambda table, key, n, short="[]": f"""SELECT {key} AS id, b, b + length(line) AS e, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) ELSE {short} END) AS g
FROM (SELECT {key}, b, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE line <> '')"""  # noqa: E731
_BENCH_LINES = "bl AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, 0 AS b FROM benchmark)"


def _overlap_sql(n: int) -> str:
    return f"SELECT t.id, t.b, t.e, count(r.g) AS hits, count(*) AS grams FROM ({_GRAMS('lines', 'doc_id', n, '[line]')}) t LEFT JOIN (SELECT DISTINCT g FROM ({_GRAMS('bl', 'item_id', n, '[line]')})) r ON t.g = r.g GROUP BY ALL"


@query(f'WITH {_LINES}, {_BENCH_LINES} SELECT id AS doc_id, b AS "begin", e::BIGINT AS "end", hits::DOUBLE / grams AS score FROM ({_overlap_sql(8)}) WHERE hits > 0')
def decontaminate_ngrams(t):
    return overlap.ngram_overlap(t.documents, t.benchmark, 8, "doc_id", "text", "item_id", "text")


@query(f'WITH {_LINES} SELECT doc_id, b AS "begin", (b + length(line))::BIGINT AS "end", 1.0::DOUBLE AS score FROM lines WHERE line <> \'\' AND line IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark)')
def decontaminate_exact(t):
    return overlap.exact_overlap(t.documents, t.benchmark, "doc_id", "text", "text")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_LINES}, {_BENCH_LINES} SELECT id AS doc_id, b AS \"begin\", e::BIGINT AS \"end\", hits::DOUBLE / grams AS score, {n}::BIGINT AS n FROM ({_overlap_sql(n)}) WHERE hits > 0)" for n in (10, 15)))
def overlap_sizes(t):
    return overlap.overlap_by_sizes(t.documents, t.benchmark, (10, 15), "doc_id", "text", "item_id", "text")


@query(f"""WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line, 0 AS b FROM documents), {_BENCH_LINES},
hits AS (SELECT DISTINCT t.id AS train, i.id AS item FROM ({_GRAMS('lines', 'source', 8)}) t JOIN ({_GRAMS('bl', 'item_id', 8)}) i ON t.g = i.g),
each AS (SELECT train, count(*) AS overlapping FROM hits GROUP BY train UNION ALL SELECT 'union', count(DISTINCT item) FROM hits)
SELECT train, overlapping, (SELECT count(*) FROM benchmark) AS eval_size, overlapping::DOUBLE / (SELECT count(*) FROM benchmark) AS fraction FROM each""")
def contamination_matrix(t):
    return overlap.contamination_matrix(t.documents, t.benchmark, 8, "source", "item_id", "text", "text")


# Consolidation, sampling, validation, classification.


@query("SELECT doc_id, lang FROM documents JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id) USING (doc_id) WHERE q >= 1 AND NOT (x >= 1)")
def consolidate_thresholds(t):
    wanted = [consolidate.Threshold("quality", lower=1), consolidate.Threshold("toxic", lower=1, reverse=True)]
    return consolidate.keep(t.documents.select("doc_id", "lang"), t.labels, wanted, "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= (SELECT quantile_disc(n_chars, 0.7) FROM documents)")
def consolidate_keep_fraction(t):
    own = t.documents.select("doc_id", "n_chars")
    return consolidate.keep(own, own.select("doc_id", F.col("n_chars").alias("score")), [consolidate.Threshold("score", keep_fraction=0.3)], "doc_id", exact=True)


@query(f"""WITH {_MARKED}, kept AS (SELECT doc_id, pos, line, b FROM lines),
marks AS (SELECT doc_id, b FROM p WHERE cnt > 1 AND canonical <> doc_id),
cut AS (SELECT k.doc_id, string_agg(CASE WHEN m.b IS NULL THEN line ELSE '' END, chr(10) ORDER BY pos) AS text FROM kept k LEFT JOIN marks m ON k.doc_id = m.doc_id AND k.b = m.b AND k.line <> '' GROUP BY k.doc_id)
SELECT doc_id, text FROM cut WHERE text <> ''""")
def consolidate_remove_spans(t):
    return consolidate.without_spans(t.documents.select("doc_id", "text"), dedup.exact_paragraphs(t.documents), "doc_id")


_DRAW = lambda seed, key: f"(('0x' || substr(md5('{seed}:' || {key}), 1, 7))::BIGINT)::DOUBLE / {16**7}"


@query(f"SELECT doc_id FROM documents WHERE {_DRAW('sample', 'doc_id')} < 0.25")
def sample_bernoulli(t):
    return sampling.bernoulli(t.documents.select("doc_id"), 0.25, "doc_id")


@query(f"SELECT doc_id, CASE WHEN {_DRAW('split', 'doc_id')} < 0.1 THEN 'validation' ELSE 'train' END AS part FROM documents")
def train_validation_split(t):
    return sampling.split(t.documents.select("doc_id"), 0.1, "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('reservoir:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def sample_reservoir(t):
    return sampling.reservoir(t.documents.select("source", "doc_id"), 5, "doc_id", ["source"])


@query("SELECT doc_id FROM documents ORDER BY md5('shuffle:' || doc_id), doc_id LIMIT 100")
def shuffled_head(t):
    return sampling.shuffled(t.documents.select("doc_id"), "doc_id").limit(100)


@query("SELECT source, count(*) AS docs, sum(strlen(text))::BIGINT AS total_bytes, round(avg(strlen(text)), 6) AS mean_bytes, round(stddev_pop(strlen(text)), 6) AS std_bytes, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY source")
def validate_statistics(t):
    stats = validate.length_statistics(t.documents, ["source"])
    return stats.select("source", "docs", "total_bytes", *(F.round(c, 6).alias(c) for c in ("mean_bytes", "std_bytes", "mean_chars")))


@query("SELECT count(*)::BIGINT AS n, round(avg(strlen(text)), 5) AS mean, round(stddev_pop(strlen(text)), 5) AS std FROM documents")
def validate_pooled(t):
    pooled = validate.pooled(validate.length_statistics(t.documents, ["source"]), "docs", "mean_bytes", "std_bytes")
    return pooled.select(F.col("n").cast("long").alias("n"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("SELECT 'text' AS field, count(*) FILTER (text IS NULL) AS missing FROM documents UNION ALL SELECT 'created', count(*) FROM documents")
def validate_fields(t):
    return validate.required_fields(t.documents, ["text", "created"])


@query()
def classify_quality(t):
    labelled = t.documents.join(t.labels, "doc_id")
    model = classify.LinearModel.fit(labelled, "text", "quality", "doc_id")
    docs = spread(t.documents.select("doc_id", "text"))
    return classify.predictions(docs, model, "doc_id", "text").select("doc_id", F.round("score", 4).alias("score"))


@query()
def classify_toxic(t):
    labelled = t.documents.join(t.labels, "doc_id")
    model = classify.LinearModel.fit(labelled, "text", "toxic", "doc_id", balanced=True)
    docs = spread(t.documents.select("doc_id", "text"))
    scored = classify.predictions(docs, model, "doc_id", "text")
    return scored.select("doc_id", F.round("score", 4).alias("score"), (F.col("score") > 0.5).alias("toxic"))


# Conversations and questions.


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_text(t):
    return conversations.gathered(t.conversations).select("conv_id", conversations.as_text(F.col("messages")).alias("text"))


@query("SELECT conv_id, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS id, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id")
def conversation_ids(t):
    chats = conversations.gathered(t.conversations)
    mapped = chats.select("conv_id", conversations.mapped_messages(F.col("messages")).alias("m"))
    return mapped.select("conv_id", conversations.content_id(F.col("m")).alias("id"), F.size("m").cast("long").alias("turns"))


@query("SELECT conv_id, max(text) FILTER (turn = 0) AS instruction, max(text) FILTER (turn = 1) AS response FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn = 0 AND text IS NOT NULL) > 0 AND count(*) FILTER (turn = 1 AND text IS NOT NULL) > 0")
def instruction_pairs(t):
    sides = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("i"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("r"))
    made = sides.select("conv_id", conversations.instruction_response(F.col("i"), F.col("r")).alias("m")).where("m is not null")
    return made.select("conv_id", F.col("m")[0]["content"].alias("instruction"), F.col("m")[1]["content"].alias("response"))


@query("SELECT n_nationkey, 'Where is ' || n_name || '?' || chr(10) || string_agg(chr(65 + r_regionkey) || '. ' || r_name, chr(10) ORDER BY r_regionkey) || chr(10) || 'Answer:' AS prompt, max(chr(65 + r_regionkey) || '. ' || r_name) FILTER (r_regionkey = n_regionkey) AS response FROM nation, region GROUP BY n_nationkey, n_name")
def choice_questions(t):
    options = t.region.agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("options"))
    asked = t.nation.join(F.broadcast(options))  # one row
    return asked.select("n_nationkey", conversations.choice_prompt(F.concat(F.lit("Where is "), F.col("n_name"), F.lit("?")), F.col("options")).alias("prompt"), conversations.choice_response(F.col("options"), F.col("n_regionkey")).alias("response"))


# Training views.


def _word_lengths(t) -> DataFrame:
    return spread(t.documents.select("doc_id", "source", "text")).select("doc_id", "source", F.transform(text.words(F.col("text")), lambda w: F.length(w).cast("long")).alias("ids"))


@query("""WITH w AS (SELECT source, doc_id, i, length(x)::BIGINT AS v FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS x, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM documents)),
p AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS r FROM w)
SELECT source, (r // 256)::BIGINT AS chunk, sum(v * (r % 256 + 1))::BIGINT AS weighed FROM p GROUP BY ALL HAVING count(*) = 256""")
def sequence_chunks(t):
    chunks = training.sequence_chunks(_word_lengths(t), 256, group=["source"])
    return chunks.select("source", "chunk", F.aggregate(F.transform("ids", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("weighed"))


@query("""WITH RECURSIVE s AS (SELECT source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, r, 0::BIGINT AS pack, n AS tokens, 1::BIGINT AS documents FROM s WHERE r = 1 UNION ALL
SELECT s.source, s.r, f.pack + c, CASE WHEN c = 1 THEN s.n ELSE f.tokens + s.n END, CASE WHEN c = 1 THEN 1 ELSE f.documents + 1 END
FROM (SELECT f.*, s.n AS sn, CASE WHEN f.tokens + s.n > 8192 OR f.documents >= 4 THEN 1 ELSE 0 END AS c FROM f JOIN s ON s.source = f.source AND s.r = f.r + 1) f JOIN s ON s.source = f.source AND s.r = f.r + 1)
SELECT source, pack, max(documents) AS documents, max(tokens) AS tokens FROM f GROUP BY source, pack""")
def greedy_packs(t):
    return training.greedy_packs(t.documents.select("source", "doc_id", "n_chars"), 8192, 4, ["source"], "doc_id", "n_chars")


@query("SELECT range AS idx, (7 * range + 3) % 1000 AS permuted FROM range(1000)")
def linear_permutation(t):
    return t.spark.range(1000).select(F.col("id").alias("idx"), training.linear_permutation(F.col("id"), 1000, 7, 3).alias("permuted"))


def _network_sql(source: str, value: str, keys: tuple[int, ...], half: int) -> str:
    """``idx, x``: the values of ``source`` after the network, round by round."""
    mask = (1 << half) - 1
    inner = f"SELECT idx, {value} >> {half} AS l, {value} & {mask} AS r FROM {source}"
    for key in keys:
        inner = f"SELECT idx, r AS l, xor(l, ((r * {training.FEISTEL_FACTOR} + {key}) & {mask})) AS r FROM ({inner})"
    return f"SELECT idx, (l << {half}) | r AS x FROM ({inner})"


_KEYS = (11, 222, 3333, 44444, 555555)


@query(f"WITH RECURSIVE walk AS ({_network_sql('(SELECT range AS idx, range AS x FROM range(1000))', 'x', _KEYS, 5)} UNION ALL {_network_sql('(SELECT idx, x FROM walk WHERE x >= 1000)', 'x', _KEYS, 5)}) SELECT idx, x AS permuted FROM walk WHERE x < 1000")
def feistel_permutation(t):
    return t.spark.range(1000).select(F.col("id").alias("idx"), training.feistel_permutation(F.col("id"), 1000, _KEYS).alias("permuted"))


@query("SELECT range AS idx, (range // 64) * 64 + (101 * (range % 64) + 5) % least(64, 1000 - (range // 64) * 64) AS permuted FROM range(1000)")
def era_permutation(t):
    return t.spark.range(1000).select(F.col("id").alias("idx"), training.era_permutation(F.col("id"), 1000, 64, 101, 5).alias("permuted"))


@query("""WITH s AS (SELECT range AS idx, range // 10 AS block, (1000003 * (range % 10) + (range // 10) * 7919) % 10 AS slot FROM range(70))
SELECT idx, block, CASE WHEN slot < 5 THEN 'a' WHEN slot < 8 THEN 'b' ELSE 'c' END AS dataset,
CASE WHEN slot < 5 THEN (block * 5 + slot) % 5 WHEN slot < 8 THEN (block * 3 + slot - 5) % 7 ELSE (block * 2 + slot - 8) % 3 END AS item FROM s""")
def mixture_blocks(t):
    return training.mixture_blocks(t.spark, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 5, "b": 7, "c": 3}, 7, 10)


@query("WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY md5('slice:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS b FROM documents) SELECT doc_id, n_chars FROM o WHERE b <= 500000")
def token_budget(t):
    return training.token_budget(t.documents.select("doc_id", "n_chars"), 500_000, "doc_id", "n_chars")


_NUMBERED = "d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n, n_chars FROM documents)"


@query(f"WITH {_NUMBERED}, p AS (SELECT unnest(range((SELECT 5 * count(*) // 2 FROM documents))) AS position) SELECT position, idx, position // n AS epoch, n_chars FROM p JOIN d ON idx = position % n")
def epoch_wrap(t):
    indexed, n = training.numbered(t.documents.select("doc_id", "n_chars"), "doc_id")
    return training.epochs(indexed.drop("doc_id"), n, 5 * n // 2)


@query(f"WITH {_NUMBERED} SELECT idx FROM d WHERE idx < n // 4")
def simulated_epoch(t):
    indexed, n = training.numbered(t.documents.select("doc_id"), "doc_id")
    return training.simulated_epoch(indexed.select("idx"), n, 1, 4)


@query("SELECT event_id, user_id, round(CASE WHEN count(*) OVER w > 1 THEN value - (sum(value) OVER w - value) / (count(*) OVER w - 1) ELSE 0 END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def leave_one_out_advantage(t):
    scored = training.leave_one_out_advantage(t.events.select("event_id", "user_id", "value"), ["user_id"], "value")
    return scored.select("event_id", "user_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT event_id, event_type, rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rank FROM events WHERE event_id BETWEEN 4000 AND 9000) WHERE rank <= 50")
def replay_buffer(t):
    kept = training.replay_buffer(t.events, 50, 9000, 5000, ["event_type"], at="event_id")
    return kept.select("event_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ln(greatest({_DRAW('replay', 'event_id')}, 1e-12)) / (event_id + 1) DESC, event_id) AS r FROM events) WHERE r <= 10")
def replay_sample(t):
    return training.weighted_draw(t.events.select("event_type", "event_id"), 10, ["event_type"], F.col("event_id") + 1, "event_id")


@query("WITH r AS (SELECT o_orderpriority AS lesson, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT lesson, greatest(0, 4 * s - 4 * s * s) * (1 + exp(-0.01 * n)) AS raw FROM r), f AS (SELECT lesson, greatest(raw / (1 + sum(raw) OVER ()), 0.05) AS f FROM w) SELECT lesson, round(f / sum(f) OVER (), 9) AS weight FROM f")
def curriculum_weights(t):
    lessons = t.orders.groupBy(F.col("o_orderpriority").alias("lesson")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    return training.curriculum_weights(lessons, "s", "n", 0.05).select("lesson", F.round("weight", 9).alias("weight"))


@query("WITH RECURSIVE s AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), f AS (SELECT user_id, r, 0.9 * 0.5 + 0.1 * v AS a FROM s WHERE r = 1 UNION ALL SELECT s.user_id, s.r, 0.9 * f.a + 0.1 * s.v FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1) SELECT user_id, round(arg_max(a, r), 6) AS average FROM f GROUP BY user_id")
def moving_average(t):
    return training.moving_average(t.events, ["user_id"], "event_id", "value").select("user_id", F.round("average", 6).alias("average"))


@query("SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS tokens, (sum(n_chars) // 2048)::BIGINT AS sequences, round(sum(greatest(n_chars - 2048, 0))::DOUBLE / sum(n_chars), 9) AS truncated FROM documents GROUP BY source")
def corpus_size(t):
    return validate.corpus_size(t.documents, "n_chars", 2048, ["source"]).withColumn("truncated", F.round("truncated", 9))


# Skew, sessions and time.


@query("SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session")
def sessions(t):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(order) > F.expr("INTERVAL 1 DAY"), 1).otherwise(0)
    numbered = t.events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("session")


from . import further  # noqa: E402, F401  (registers more queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql is not None}
