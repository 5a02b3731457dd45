"""The query catalogue: each query over the standard tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.functions import javasrc, text
from quarryloom.operators import candidates, columns, joins, masks, metrics, order, outcomes, spans, subwords, tasks, templates
from quarryloom.sources import archives, files, scratch, sinks
from quarryloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- candidates -------------------------------------------------------------------------

#: DuckDB form of is_balanced for an expression.
BALANCED = """(coalesce(list_reduce(list_prepend('', string_split(regexp_replace({x}, '[^(){{}}\\[\\]]', '', 'g'), '')),
  lambda s, c: CASE WHEN s = 'X' THEN s WHEN c IN ('(', '{{', '[') THEN s || c WHEN c = '' THEN s
    WHEN right(s, 1) = translate(c, ')}}]', '({{[') THEN left(s, len(s) - 1) ELSE 'X' END), '') = '')"""
PLAIN = "regexp_replace(text, '[(){}\\[\\]]', '', 'g')"
JUDGED = f"""judged AS (SELECT conv_id, turn, text, coalesce({BALANCED.format(x="text")} AND length(text) < 120, false) AS raw_ok,
  {PLAIN} AS fixed, coalesce(length({PLAIN}) < 140, false) AS fixed_ok FROM conversations)"""
CHOSEN = f"""WITH {JUDGED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY NOT (raw_ok OR fixed_ok), turn, text) AS nth FROM judged),
chosen AS (SELECT conv_id, turn AS chosen_pos,
  CASE WHEN raw_ok OR NOT fixed_ok THEN text ELSE fixed END AS chosen, NOT raw_ok AND fixed_ok AS used_repair, NOT (raw_ok OR fixed_ok) AS fell_back FROM ranked WHERE nth = 1)"""
#: As many positions as the longest conversation has turns.
POSITIONS = "(SELECT unnest(range((SELECT max(turn) + 1 FROM conversations))) AS pos)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as candidates: balanced and short is valid, without brackets and a little longer is a repair."""
    df = table(spark, sf_dir, "conversations")
    fixed = F.regexp_replace("text", r"[(){}\[\]]", "")
    return candidates.judged(df.select("conv_id", "turn", "text"), text.is_balanced(F.col("text")) & (F.length("text") < 120), fixed, F.length(fixed) < 140)


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.first_valid(_judged(spark, sf_dir), "conv_id", "turn", "text")


@query(f"{CHOSEN} SELECT conv_id, chosen_pos, chosen, used_repair, fell_back FROM chosen")
def first_valid_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir)


@query(f"{CHOSEN} SELECT conv_id, chosen_pos, chosen, used_repair, fell_back FROM chosen")
def first_valid_early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same choice where a candidate is judged only while its input has none valid before it."""
    fixed = F.regexp_replace("text", r"[(){}\[\]]", "")
    judge = lambda df: candidates.judged(df, text.is_balanced(F.col("text")) & (F.length("text") < 120), fixed, F.length(fixed) < 140)
    return candidates.first_valid_lazily(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", judge)


@query(f"""{CHOSEN} SELECT r.pos, count(*) FILTER (WHERE c.conv_id IS NOT NULL AND NOT used_repair) AS n_raw, count(*) FILTER (WHERE used_repair) AS n_repaired
FROM {POSITIONS} r LEFT JOIN (SELECT * FROM chosen WHERE NOT fell_back) c ON c.chosen_pos = r.pos GROUP BY r.pos""")
def candidate_position_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.position_histogram(_chosen(spark, sf_dir), candidates.width(table(spark, sf_dir, "conversations"), "turn"))


@query(f"{CHOSEN} SELECT count(*) AS n_inputs, count(*) FILTER (WHERE fell_back) AS n_all_failed FROM chosen")
def candidates_all_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.all_failed(_chosen(spark, sf_dir))


@query(f"""WITH {JUDGED} SELECT r.pos, count(*) FILTER (WHERE raw_ok) AS n_valid
FROM {POSITIONS} r LEFT JOIN judged j ON j.turn = r.pos GROUP BY r.pos""")
def candidate_validate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    return candidates.validity_by_position(rows, "turn", candidates.width(rows, "turn"))


#: A view needs a fixed list of names: the conversations of the tables up to sf0.1 have eight turns.
@query(f"""SELECT * FROM (SELECT conv_id, text, 'generated_test_' || (turn + 1) AS name, CAST((SELECT max(turn) + 1 FROM conversations) AS INTEGER) AS num_results FROM conversations)
PIVOT (max(text) FOR name IN ({", ".join(f"'generated_test_{i}'" for i in range(1, 9))}) GROUP BY conv_id, num_results)""")
def candidate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many columns as the longest conversation has turns."""
    turns = table(spark, sf_dir, "conversations")
    return candidates.pivoted(turns, "conv_id", "turn", "text", candidates.width(turns, "turn"))


@query("SELECT conv_id, CAST(turn AS INTEGER) AS cand_pos, max(text) AS code FROM conversations GROUP BY ALL HAVING max(text) <> ''")
def candidate_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = candidate_pivot(spark, sf_dir)
    return candidates.unpivoted(wide, "conv_id", len(wide.columns) - 2)


@query("""WITH flat AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS f FROM orders GROUP BY o_custkey)
SELECT o_custkey, """ + ", ".join(f"array_to_string(list_transform(list_filter(range(len(f)), lambda j: j % 3 = {i}), lambda j: f[j + 1]), ',') AS part_{i + 1}" for i in range(3)) + " FROM flat")
def candidates_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("f"))
    return flat.select("o_custkey", *[F.array_join(c.cast("array<string>"), ",").alias(f"part_{i + 1}") for i, c in enumerate(candidates.strided(F.col("f"), 3))])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE turn % 3 = 0) AS n_other FROM conversations WHERE text IS NOT NULL")
def prefix_miss_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("turn") % 3 == 0, "").otherwise("@Test "), F.translate("text", "@", "a"))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(line.alias("line"))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.startswith("line", F.lit("@Test"))).alias("n_other"))


@query("""WITH m AS (SELECT conv_id, min(turn) FILTER (WHERE length(text) < 120) AS first_pos, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.text AS code, d.text AS target FROM conversations c JOIN m ON m.conv_id = c.conv_id AND m.first_pos = c.turn JOIN documents d ON d.doc_id = c.conv_id""")
def predictions_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    first = c.where(F.length("text") < 120).groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return c.join(first, ["conv_id", "turn"]).join(d.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("target")), "conv_id").select("conv_id", "turn", F.col("text").alias("code"), "target")


_METHOD = "'int m' || turn || '() { ' || coalesce(translate(text, '(){}[]\"''/\\\\', ''), '') || CASE WHEN turn % 3 = 0 THEN '' ELSE '; }' END"


@query(f"""WITH j AS (SELECT conv_id, turn, {_METHOD} AS code, turn % 3 <> 0 AS ok FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY NOT ok, turn, code) AS nth FROM j)
SELECT conv_id, turn AS chosen_pos, NOT ok AS fell_back, CASE WHEN ok THEN '@Test public int testM' || substr(code, 6) ELSE code END AS chosen FROM r WHERE nth = 1""")
def chosen_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid method of a conversation, renamed and annotated; a fallback stays as it was."""
    tasks.small_batches(spark)
    code = F.concat(F.lit("int m"), F.col("turn").cast("string"), F.lit("() { "), F.coalesce(F.translate("text", "(){}[]\"'/\\", ""), F.lit("")), F.when(F.col("turn") % 3 == 0, "").otherwise("; }"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", code.alias("code"))
    judged = candidates.judged(rows, text.is_balanced(F.col("code")), F.col("code"), F.lit(False))
    chosen = candidates.edited(candidates.first_valid(judged, "conv_id", "turn", "code"), javasrc.adapt_name)
    return chosen.select("conv_id", "chosen_pos", "fell_back", "chosen")


# --- tokens -----------------------------------------------------------------------------

TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("tokens"))


def _cut_sql(kind: str, size: str) -> str:
    draws = f"list_transform(range({size} - k + 1, {size}), lambda i: i || ':' || (CAST('0x' || left(md5('42|{kind}|' || doc_id || '|' || i), 15) AS BIGINT) % i + 1))"
    chosen = f"list_reduce(list_prepend(',', {draws}), lambda a, x: a || split_part(x, ':', CASE WHEN contains(a, ',' || split_part(x, ':', 2) || ',') THEN 1 ELSE 2 END) || ',')"
    numbers = f"list_sort(list_transform(list_filter(string_split({chosen}, ','), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)))"
    return f"CASE WHEN k > 1 THEN list_concat(list_concat([0], {numbers}), [{size}]) ELSE [0, {size}] END"


@query(f"""WITH t AS (SELECT doc_id, list_concat(['<s>'], ({TOKENS})[1:1024]) AS ids FROM documents),
n AS (SELECT *, len(ids) AS n, CAST(least(greatest(round_even(len(ids) * 0.15, 0), 1), len(ids) - 1) AS INTEGER) AS nz FROM t WHERE len(ids) >= 2),
s AS (SELECT *, CAST(n - nz AS INTEGER) AS nn, CAST(least(greatest(1, round_even(least(nz, n - nz) / 3.0, 0)), nz, n - nz) AS INTEGER) AS k FROM n),
c AS (SELECT *, {_cut_sql("z", "nz")} AS cz, {_cut_sql("k", "nn")} AS ck FROM s)
SELECT doc_id, CAST(n AS INTEGER) AS n, nz AS n_noise, k AS n_spans,
 md5(array_to_string(list_concat(flatten(list_transform(range(1, k + 1), lambda j: list_concat(ids[ck[j] + cz[j] + 1 : ck[j + 1] + cz[j]], ['<' || (32100 - j) || '>']))), ['</s>']), ' ')) AS inputs_md5,
 md5(array_to_string(list_concat(flatten(list_transform(range(1, k + 1), lambda j: list_concat(['<' || (32100 - j) || '>'], ids[ck[j + 1] + cz[j] + 1 : ck[j + 1] + cz[j + 1]]))), ['</s>']), ' ')) AS labels_md5
FROM c""")
def span_corrupt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).withColumn("ids", spans.with_bos(F.col("tokens")))
    done = spans.corrupt(rows, "doc_id", "ids", 32100)
    return done.select("doc_id", "n", "n_noise", "n_spans", F.md5(F.array_join("inputs", " ")).alias("inputs_md5"), F.md5(F.array_join("labels", " ")).alias("labels_md5"))


_IDS = f"list_transform({TOKENS}, lambda t: CAST(length(t) AS INTEGER))"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand in for ids, eight documents make a batch."""
    return _tokens(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch_id"), F.transform("tokens", lambda t: F.length(t)).alias("ids"))


@query(f"""WITH t AS (SELECT doc_id, doc_id // 8 AS batch_id, {_IDS} AS ids FROM documents), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM t)
SELECT doc_id, CAST(width AS INTEGER) AS width,
 array_to_string(list_resize(list_concat([0], list_transform(ids[1:greatest(len(ids) - 1, 0)], lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)), greatest(width, 1), 0), ',') AS decoder_ids,
 list_sum(list_resize(list_transform(ids, lambda x: 1), width, 0)) AS mask_ones,
 array_to_string(list_resize(ids, width, -100), ',') AS labels FROM w WHERE len(ids) > 0""")
def shift_right_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.batch_width(_lengths(spark, sf_dir), "batch_id", "ids").where(F.size("ids") > 0)
    shifted = spans.padded(spans.shifted_right(F.col("ids"), 0, 0), F.col("width"), 0)
    mask = F.aggregate(spans.attention_mask(F.col("ids"), F.col("width")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "width", F.array_join(shifted.cast("array<string>"), ",").alias("decoder_ids"), mask.alias("mask_ones"), F.array_join(spans.padded(F.col("ids"), F.col("width"), spans.IGNORE).cast("array<string>"), ",").alias("labels"))


@query(f"""WITH t AS (SELECT doc_id, doc_id // 8 AS batch_id, {_IDS} AS ids FROM documents), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM t),
p AS (SELECT doc_id, list_resize(ids, width, 0) AS ids FROM w), l AS (SELECT *, list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels FROM p)
SELECT doc_id, array_to_string(labels, ',') AS labels, len(list_filter(labels, lambda x: x = -100)) AS n_ignored, list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) = ids AS restored FROM l""")
def label_ignore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.batch_width(_lengths(spark, sf_dir), "batch_id", "ids")
    return _ignored_and_back(rows.select("doc_id", spans.padded(F.col("ids"), F.col("width"), 0).alias("ids")))


def _ignored_and_back(padded: DataFrame) -> DataFrame:
    rows = padded.withColumn("labels", spans.ignored(F.col("ids"), 0))
    return rows.select("doc_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.size(F.filter("labels", lambda x: x == spans.IGNORE)).cast("long").alias("n_ignored"), (spans.unignored(F.col("labels"), 0) == F.col("ids")).alias("restored"))


@query(f"""WITH b AS (SELECT doc_id // 100 AS batch_id, flatten(list({TOKENS} ORDER BY doc_id)) AS a FROM documents GROUP BY 1),
c AS (SELECT batch_id, a, unnest(range(CASE WHEN len(a) >= 512 THEN len(a) // 512 WHEN len(a) > 0 THEN 1 ELSE 0 END)) AS chunk FROM b)
SELECT batch_id, CAST(chunk AS INTEGER) AS chunk, md5(array_to_string(a[chunk * 512 + 1 : chunk * 512 + 512], ' ')) AS tokens_md5, CAST(len(a[chunk * 512 + 1 : chunk * 512 + 512]) AS INTEGER) AS n FROM c""")
def pack_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / 100))
    done = spans.packed_chunks(rows, "batch_id", "doc_id", "tokens", 512)
    return done.select("batch_id", "chunk", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.size("tokens").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, len({TOKENS}) AS n FROM documents) SELECT doc_id, CAST(list_aggregate([1, round_even(n * 0.15, 0)], 'max') AS INTEGER) AS n_noise FROM t WHERE n > 1""")
def noise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).select("doc_id", F.size("tokens").alias("n")).where("n > 1")
    return rows.select("doc_id", spans.span_counts(F.col("n"), 0.15, 3.0)[0].alias("n_noise"))


_DENSITIES = (0.15, 0.3, 0.5)


@query(r"""WITH w AS (SELECT conv_id, turn, greatest(16, len(string_split_regex(coalesce(text, ''), '\s+'))) AS l FROM conversations),
c AS (SELECT l, d FROM (SELECT DISTINCT l FROM w) a, (SELECT unnest([0.15::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS d) b),
n AS (SELECT l, d, unnest(range(l, 3 * l + 8)) AS n FROM c), x AS (SELECT *, round_even(n * d, 0)::BIGINT AS noise FROM n), y AS (SELECT *, round_even(noise / 3.0::DOUBLE, 0)::BIGINT AS spans FROM x),
m AS (SELECT l, d, max(n) FILTER (WHERE n = l OR n - noise + spans + 1 <= l) AS n FROM y GROUP BY ALL), r AS (SELECT y.*, noise + spans + 1 AS t, n - noise + spans + 1 AS i FROM y JOIN m USING (l, d, n))
SELECT conv_id, turn, CAST(l AS INTEGER) AS inputs_length, d AS density, CAST(n - CASE WHEN d = 0.5 AND t > i THEN 1 ELSE 0 END AS INTEGER) AS tokens_length, CAST(t - CASE WHEN d = 0.5 AND t > i THEN 1 ELSE 0 END AS INTEGER) AS targets_length FROM w JOIN r USING (l)""")
def target_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and target lengths where inputs are to be as long as each turn, 16 at least."""
    n = F.greatest(F.lit(16), F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("inputs_length"), F.explode(F.array(*map(F.lit, _DENSITIES))).alias("density"))
    found = spans.target_lengths(F.col("inputs_length"), F.col("density"), 3.0)
    return rows.withColumn("x", found).select("conv_id", "turn", "inputs_length", "density", "x.tokens_length", "x.targets_length")


#: Raw tokens whose corrupted inputs have 128 tokens, and their labels' length.
RAW, LABELS = spans.raw_and_target_lengths(128, 0.15, 3.0)


@query(f"""WITH b AS (SELECT doc_id // 100 AS batch_id, flatten(list({TOKENS} ORDER BY doc_id)) AS a FROM documents GROUP BY 1),
t AS (SELECT batch_id || ':' || chunk AS doc_id, a[chunk * {RAW} + 1 : chunk * {RAW} + {RAW}] AS ids FROM (SELECT batch_id, a, unnest(range(len(a) // {RAW})) AS chunk FROM b)),
n AS (SELECT *, len(ids) AS n, CAST(least(greatest(round_even(len(ids) * 0.15, 0), 1), len(ids) - 1) AS INTEGER) AS nz FROM t),
s AS (SELECT *, CAST(n - nz AS INTEGER) AS nn, CAST(greatest(1, round_even(nz / 3.0, 0)) AS INTEGER) AS k FROM n),
c AS (SELECT *, {_cut_sql("z", "nz")} AS cz, {_cut_sql("k", "nn")} AS ck FROM s)
SELECT doc_id AS chunk_id, nz AS n_noise, k AS n_spans, 128 AS n_inputs, {LABELS} AS n_labels,
 md5(array_to_string(list_concat(flatten(list_transform(range(1, k + 1), lambda j: list_concat(ids[ck[j] + cz[j] + 1 : ck[j + 1] + cz[j]], ['<' || (32100 - j) || '>']))), ['</s>']), ' ')) AS inputs_md5,
 md5(array_to_string(list_concat(flatten(list_transform(range(1, k + 1), lambda j: list_concat(['<' || (32100 - j) || '>'], ids[ck[j + 1] + cz[j] + 1 : ck[j + 1] + cz[j + 1]]))), ['</s>']), ' ')) AS labels_md5
FROM c""")
def span_corrupt_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed-length path: full chunks of raw tokens, corrupted, each of exactly the configured lengths; a wrong one raises."""
    rows = _tokens(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / 100))
    chunks = spans.packed_chunks(rows, "batch_id", "doc_id", "tokens", RAW).where(F.size("tokens") == RAW)
    named = chunks.select(F.concat_ws(":", F.col("batch_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), "tokens")
    done = spans.guarded(spans.corrupt(named, "chunk_id", "tokens", 32100, dynamic=False), "inputs", "labels", 128, LABELS)
    sizes = [F.size(c).alias(f"n_{c}") for c in ("inputs", "labels")]
    return done.select("chunk_id", "n_noise", "n_spans", *sizes, F.md5(F.array_join("inputs", " ")).alias("inputs_md5"), F.md5(F.array_join("labels", " ")).alias("labels_md5"))


@query(f"""WITH t AS (SELECT doc_id, 1 + least(len({TOKENS}), 1024) AS n FROM documents), z AS (SELECT *, CAST(least(greatest(round_even(n * 0.15, 0), 1), n - 1) AS INTEGER) AS nz FROM t WHERE n >= 2),
k AS (SELECT *, CAST(least(greatest(1, round_even(least(nz, n - nz) / 3.0, 0)), nz, n - nz) AS INTEGER) AS k FROM z)
SELECT doc_id, n - nz + k + 1 <= 512 AS fits, n - nz + k + 1 = 512 AND nz + k + 1 = 114 AS exact FROM k""")
def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which corrupted documents have 512 inputs at most, and which exactly 512 with 114 labels."""
    done = spans.corrupt(_tokens(spark, sf_dir).withColumn("ids", spans.with_bos(F.col("tokens"))), "doc_id", "ids", 32100)
    inputs, labels = F.col("inputs"), F.col("labels")
    return done.select("doc_id", spans.lengths_fit(inputs, labels, 512).alias("fits"), spans.lengths_fit(inputs, labels, 512, 114).alias("exact"))


@query(f"""WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {TOKENS} AS w FROM documents)), m AS (SELECT doc_id, i, length(w) > 5 AS noise FROM t),
b AS (SELECT *, CASE WHEN lag(noise) OVER (PARTITION BY doc_id ORDER BY i) = noise THEN 0 ELSE 1 END AS begins FROM m), r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
g AS (SELECT doc_id, run, min(i) - 1 AS first, count(*) AS n, bool_or(noise) AS noise FROM r GROUP BY ALL)
SELECT doc_id, first, CAST(n AS BIGINT) AS length, noise FROM g""")
def noise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of long and of short words of each document, whose mask comes in pieces of 100."""
    rows = _tokens(spark, sf_dir).select("doc_id", F.transform("tokens", lambda t: F.length(t) > 5).alias("mask"))
    pieces = F.explode(F.sequence(F.lit(0), F.floor(F.size("mask") / 100).cast("int"))).alias("piece")
    rows = rows.where(F.size("mask") > 0).select("doc_id", "mask", pieces).select("doc_id", "piece", F.slice("mask", F.col("piece") * 100 + 1, F.lit(100)).alias("mask"))
    return masks.runs_of_pieces(rows, "doc_id", "piece", "mask")


#: Where the public vocabularies are; a caller of subwords names any file.
SUBWORDS = "piece_bpe_32k.model"


@query()
def span_corrupt_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as subword ids, cut at 1,024, and corrupted. Beyond SQL: tests hold it against the library."""
    import public_tokenizers

    rows = subwords.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", public_tokenizers.path(SUBWORDS)).drop("text")
    rows = rows.withColumn("ids", F.col("ids").cast("array<string>"))
    return spans.corrupt(rows, "doc_id", "ids", 32100).select("doc_id", "n", "n_noise", "n_spans", F.array_join("inputs", " ").alias("inputs"), F.array_join("labels", " ").alias("labels"))


_PIECES = "['<pad>', '</s>', '<s>'] || (SELECT list('\u2581' || replace(n_name, '_', '\u2581') ORDER BY n_nationkey) FROM nation)"


@query(f"""WITH v AS (SELECT {_PIECES} AS p), i AS (SELECT c_custkey, [2, c_nationkey + 3, CAST(c_custkey % 25 AS INTEGER) + 3, 1, 0, 0] AS ids FROM customer)
SELECT c_custkey, replace(trim(replace(array_to_string(list_transform(ids, lambda x: p[x + 1]), ''), '\u2581', ' ')), '<pad>', '') AS kept,
 trim(replace(array_to_string(list_transform(list_filter(ids, lambda x: x > 2), lambda x: p[x + 1]), ''), '\u2581', ' ')) AS skipped FROM i, v""")
def detokenized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two nations' names between special tokens as text, with these and without."""
    names = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()  # a vocabulary, of 25 rows
    pieces = ["<pad>", "</s>", "<s>", *(spans.WORD_MARK + r["n_name"].replace("_", spans.WORD_MARK) for r in names)]
    key = F.col("c_custkey")
    ids = F.array(F.lit(2), F.col("c_nationkey") + 3, F.pmod(key, F.lit(25)).cast("int") + 3, F.lit(1), F.lit(0), F.lit(0))
    rows = spans.detokenized(table(spark, sf_dir, "customer").select("c_custkey", ids.alias("ids")), "ids", pieces, (0, 1, 2), name="kept")
    return spans.detokenized(rows, "ids", pieces, (0, 1, 2), skip_special=True, name="skipped").select("c_custkey", "kept", "skipped")


# --- order ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents),
s AS (SELECT *, (n + 4) // 5 AS held FROM r) SELECT doc_id, CASE WHEN rank < n - held THEN 'train' WHEN rank < n - (held + 1) // 2 THEN 'valid' ELSE 'test' END AS split FROM s""")
def split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.train_valid_test(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rank // 64 AS batch_id FROM r WHERE rank < n - n % 64")
def batch_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64)


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders), p AS (SELECT *, (n + 63) // 64 AS parts FROM r),
q AS (SELECT *, n // parts AS small, n % parts AS more FROM p)
SELECT o_orderkey, CASE WHEN rank < more * (small + 1) THEN rank // (small + 1) ELSE more + (rank - more * (small + 1)) // small END AS batch_id FROM q""")
def batch_indexes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, drop_last=False)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS rank FROM documents) SELECT doc_id, rank FROM r")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "rank")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1024")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1024 rows by an explicit order: the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(1024)


@query("SELECT p_partkey, p_brand, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS version_num FROM part")
def methods_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = text.version_digits(F.col("p_brand")).cast("int").alias("version_num")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", num).orderBy("version_num", "p_partkey")


# --- code text --------------------------------------------------------------------------


def _replaced(sql: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


_FORMAT = [*text.TIGHTEN, *text.KEYWORDS, *text.OPERATORS]


@query(f"SELECT page_id, md5({_replaced('html', _FORMAT)}) AS formatted_md5 FROM pages")
def format_code_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.format_code(F.col("html"))).alias("formatted_md5"))


@query("""WITH d AS (SELECT doc_id, text || ' "<AssertPlaceHolder>" ' || source || '"<AssertPlaceHolder>"' AS method FROM documents)
SELECT d.doc_id, md5(replace(method, '"<AssertPlaceHolder>"', regexp_replace(chr(10) || ' ' || b.text || ' ', '^\\s+|\\s+$', '', 'g'))) AS filled_md5 FROM d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark) b ON b.place = d.doc_id % (SELECT count(*) FROM benchmark)""")
def placeholder_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's statement is that of the item at its place among the items."""
    mark = F.lit(text.PLACEHOLDER)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    items = order.ranked(items, "item_id", "text", name="place")
    place = F.pmod(F.col("doc_id"), F.lit(max(1, items.count())))
    d = table(spark, sf_dir, "documents").select("doc_id", place.alias("place"), F.concat("text", F.lit(" "), mark, F.lit(" "), "source", mark).alias("method"))
    b = items.select("place", F.concat(F.lit("\n "), "text", F.lit(" ")).alias("statement"))
    return d.join(b, "place").select("doc_id", F.md5(text.fill_placeholder(F.col("method"), F.col("statement"))).alias("filled_md5"))


@query(f"SELECT page_id, {BALANCED.format(x='html')} AS balanced FROM pages")
def bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.is_balanced(F.col("html")).alias("balanced"))


_LINE = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE '@Test ' END || 'void ' || replace(text, '.', ';') || CASE WHEN doc_id % 2 = 0 THEN ' ( }' ELSE '' END"


@query(f"""WITH l AS (SELECT doc_id, {_LINE} AS line FROM documents),
w AS (SELECT *, {BALANCED.format(x="line")} AS ok, CASE WHEN string_split(line, ' ')[1] = '@Test' THEN string_split(line, ' ') ELSE list_prepend('@Test', string_split(line, ' ')) END AS words FROM l),
v AS (SELECT *, list_position(words, 'void') AS p FROM w),
t AS (SELECT *, list_transform(words, lambda x, i: CASE WHEN p > 0 AND i = p + 1 AND NOT starts_with(x, 'test') THEN 'test' || x ELSE x END) AS fixed FROM v),
e AS (SELECT *, list_max(list_transform(fixed, lambda x, i: CASE WHEN ends_with(x, ';') THEN i END)) AS last FROM t)
SELECT doc_id, ok, md5(CASE WHEN ok THEN array_to_string(fixed, ' ') WHEN last IS NULL THEN line ELSE array_to_string(fixed[1:last], ' ') || ' }}' END) AS mended_md5 FROM e""")
def a3_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise("@Test "), F.lit("void "), F.replace("text", F.lit("."), F.lit(";")), F.when(F.col("doc_id") % 2 == 0, " ( }").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    return rows.select("doc_id", text.is_balanced(F.col("line")).alias("ok"), F.md5(text.postprocess_test(F.col("line"))).alias("mended_md5"))


@query("""WITH c AS (SELECT p_partkey, 'org.' || lower(replace(p_brand, '#', '.')) || '.' || replace(p_type, ' ', '$') AS c, p_size FROM part)
SELECT p_partkey, replace(c, '.', '/') || '.java' AS path, split_part(c, '.', -1) AS simple, c || '_ESTest' AS test_class, split_part(split_part(replace(c, '.', '/') || '.java', '/', -1), '.', 1) AS base,
 c || '::test' || p_partkey AS canonical, concat_ws('_', 'P', p_size || 'f', p_partkey, split_part(c, '.', -1)) AS id,
 'P' AS project, p_size || 'f' AS version, p_partkey::VARCHAR AS number, split_part(split_part(c, '.', -1), '_', 1) AS class FROM c""")
def class_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("org."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))), F.lit("."), F.replace("p_type", F.lit(" "), F.lit("$")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("c"))
    c, key = F.col("c"), F.col("p_partkey").cast("string")
    composite = text.method_id(F.lit("P"), F.concat(F.col("p_size").cast("string"), F.lit("f")), key, text.simple_name(c))
    return rows.select("p_partkey", text.source_path(c).alias("path"), text.simple_name(c).alias("simple"), text.test_class(c).alias("test_class"), text.base_name(text.source_path(c)).alias("base"), text.canonical_test(c, F.concat(F.lit("test"), key)).alias("canonical"), composite.alias("id"), *text.method_id_parts(composite))


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, 'test') THEN p_name ELSE 'test' || upper(left(p_name, 1)) || substr(p_name, 2) END AS test_name FROM part")
def test_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.prefixed_test_name(F.col("p_name")).alias("test_name"))


@query("WITH l AS (SELECT o_orderkey, o_orderpriority || '||' || o_orderstatus || '|' AS j FROM orders) SELECT o_orderkey, array_to_string(list_filter(string_split(j, '|'), lambda x: x <> ''), ';') AS imports FROM l")
def import_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat("o_orderpriority", F.lit("||"), "o_orderstatus", F.lit("|"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.split_imports(joined), ";").alias("imports"))


def _size_sql(units: str) -> str:
    steps = "CASE WHEN n < 1000000 THEN 10 WHEN n < 1000000000 THEN 10000 ELSE 10000000 END"
    unit = " ".join(f"WHEN n < {limit} THEN '{u}'" for limit, u in zip((10**6, 10**9, 10**18), units.split(), strict=True))
    return f"((n + {steps} // 2) // {steps} // 100) || '.' || lpad(((n + {steps} // 2) // {steps} % 100)::VARCHAR, 2, '0') || ' ' || CASE {unit} END"


@query(f"WITH s AS (SELECT doc_id, n_chars * (doc_id + 1) * 97 AS n FROM documents) SELECT doc_id, {_size_sql('K M B')} AS count_text, {_size_sql('KB MB GB')} AS bytes_text FROM s")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * (F.col("doc_id") + 1) * 97
    return table(spark, sf_dir, "documents").select("doc_id", text.human_count(n).alias("count_text"), text.human_bytes(n).alias("bytes_text"))


@query("""WITH s AS (SELECT doc_id, n_chars * 370 + doc_id AS s FROM documents)
SELECT doc_id, CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, ' ELSE (s // 86400) || ' days, ' END || (s // 3600 % 24) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || '.25' AS delta,
 printf('%02d', s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hms FROM s""")
def timedelta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("n_chars") * 370 + F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", text.seconds_text(s + F.lit(0.25)).alias("delta"), text.elapsed(s, days=False).alias("hms"))


@query("""WITH w AS (SELECT page_id, string_split(url, '/') AS p FROM pages)
SELECT page_id, array_to_string(list_transform(list_sort(list_transform(p, lambda x, i: {'n': -length(x), 'i': -(i - 1), 'x': x})), lambda r: r.x), ' ') AS longest_first FROM w""")
def longest_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.longest_first(F.split("url", "/")), " ").alias("longest_first"))


@query("SELECT doc_id, regexp_replace(regexp_replace(source || '<pad><pad> ' || lang || '<pad>', '<pad>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents")
def padding_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip(text.remove_padding(F.concat("source", F.lit("<pad><pad> "), "lang", F.lit("<pad>")))).alias("cleaned"))


# --- templates --------------------------------------------------------------------------

_HEAD = "CASE WHEN doc_id % 2 = 0 THEN 'package p' || doc_id % 7 || ';' || chr(10) ELSE '' END || 'import a.B' || doc_id % 5 || ';' || chr(10) || 'public class ' || source || ' {' || chr(10) || text"


def _java(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    part = lambda n: F.pmod(doc, F.lit(n)).cast("string")
    code = F.concat(F.when(doc % 2 == 0, F.concat(F.lit("package p"), part(7), F.lit(";\n"))).otherwise(""), F.lit("import a.B"), part(5), F.lit(";\npublic class "), "source", F.lit(" {\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.split(code, "\n").alias("lines"))


@query(f"""WITH j AS (SELECT doc_id, string_split({_HEAD}, chr(10)) AS lines, list_filter(['import a.B1;', 'import a.B2;', 'import a.B1;'], lambda x: NOT list_contains(string_split({_HEAD}, chr(10)), x)) AS new FROM documents),
p AS (SELECT *, list_max(list_transform(lines, lambda x, i: CASE WHEN regexp_matches(x, '^\\s*package\\s+') THEN i END)) AS place FROM j)
SELECT doc_id, md5(array_to_string(CASE WHEN place IS NOT NULL AND len(new) > 0 THEN list_concat(list_concat(list_concat(lines[1:place], ['']), new), lines[place + 1:]) WHEN place IS NOT NULL THEN lines
 WHEN len(new) > 0 THEN list_concat(list_concat(list_concat(['package q;', ''], new), ['']), lines) ELSE list_concat(['package q;', ''], lines) END, chr(10))) AS edited_md5 FROM p""")
def import_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("import a.B1;", "import a.B2;", "import a.B1;")))
    return _java(spark, sf_dir).select("doc_id", F.md5(F.array_join(templates.with_imports(F.col("lines"), wanted, F.lit("package q;")), "\n")).alias("edited_md5"))


@query(f"""WITH j AS (SELECT doc_id, source, string_split({_HEAD}, chr(10)) AS lines FROM documents), p AS (SELECT *, list_min(list_transform(lines, lambda x, i: CASE WHEN contains(x, 'public class ' || source) THEN i END)) AS place FROM j),
t AS (SELECT doc_id, CASE WHEN place IS NULL THEN lines ELSE list_concat(lines[1:place], ['', '    // Test Method generated', '', '}}']) END AS lines FROM p)
SELECT doc_id, len(lines) AS n_lines, md5(replace(array_to_string(lines, chr(10)), '// Test Method generated', '@Rule' || chr(10) || '    public Timeout globalTimeout = new Timeout(10000);' || chr(10) || chr(10) || '    // Starting generated-test ' || doc_id || chr(10) || '    void m() {{}}' || chr(10) || '    // Ending generated-test ' || doc_id)) AS injected_md5 FROM t""")
def truncate_and_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _java(spark, sf_dir).select("doc_id", templates.truncated(F.col("lines"), F.col("source")).alias("lines"))
    done = templates.inject(F.col("lines"), F.col("doc_id").cast("string"), F.lit("void m() {}"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(done, "\n")).alias("injected_md5"))


# --- joins ------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey, p_size AS version, 'org.x.' || replace(p_type, ' ', '') AS modified_class FROM part), m AS (SELECT p_partkey AS method, p_size AS version, 'src/x/' || replace(p_type, ' ', '') || '.test.java' AS path_focal_class FROM part)
SELECT c.p_partkey, m.method, split_part(c.modified_class, '.', -1) AS focal_name, c.version FROM c JOIN m ON c.version = m.version AND split_part(c.modified_class, '.', -1) = split_part(split_part(m.path_focal_class, '/', -1), '.', 1)""")
def class_method_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("kind", F.replace("p_type", F.lit(" "), F.lit(""))).withColumnRenamed("p_size", "version")
    classes = part.select("p_partkey", "version", F.concat(F.lit("org.x."), "kind").alias("modified_class"))
    methods = part.select(F.col("p_partkey").alias("method"), "version", F.concat(F.lit("src/x/"), "kind", F.lit(".test.java")).alias("path_focal_class"))
    return joins.class_methods(classes, methods).select("p_partkey", "method", "focal_name", "version")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def existence_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.existing(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), listing, "o_custkey")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS words, string_split(source || ' the of ' || lang || ' the', ' ') AS wanted FROM documents)
SELECT doc_id, array_to_string(list_filter(wanted, lambda x: NOT list_contains(words, x)), ',') AS missing FROM w""")
def import_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.split(F.concat("source", F.lit(" the of "), "lang", F.lit(" the")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.missing_imports(wanted, F.split("text", " ")), ",").alias("missing"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
n AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-F]') THEN split_part(line, ' ', 1) END AS name FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS enclosing FROM n""")
def asof_enclosing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = joins.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    name = F.when(F.col("line").rlike("^[A-F]"), F.substring_index("line", " ", 1))
    return joins.enclosing(lines, "doc_id", name).select("doc_id", "line_no", "enclosing")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS file, CASE WHEN o_orderstatus = 'F' AND (o_custkey % 3 = 0 OR o_orderkey % 3 = 0) THEN 'm' || o_orderkey END AS m FROM orders),
w AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY file ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS before, count(m) OVER (PARTITION BY file) AS n, min(m) OVER (PARTITION BY file) AS sole FROM o)
SELECT o_orderkey, CASE WHEN n = 1 THEN sole ELSE before END AS method, n AS n_methods FROM w""")
def error_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method of each error's line from a table of errors and one of methods; a third of both are in one file."""
    file = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", file.alias("file"), F.col("o_orderkey").alias("line"))
    methods = orders.where("o_orderstatus = 'F' and (o_custkey % 3 = 0 or o_orderkey % 3 = 0)").select("file", "line", F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"))
    return joins.located(orders.select("o_orderkey", "file", "line"), methods).select("o_orderkey", "method", "n_methods")


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(*) AS n, sum(l_orderkey) AS keys, array_to_string(list(l_orderkey ORDER BY l_orderkey), ' ') AS orders FROM lineitem GROUP BY ALL""")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")
    found = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.array_sort(F.collect_list("l_orderkey")).alias("orders"))
    return found.withColumn("orders", F.array_join(F.col("orders").cast("array<string>"), " "))


@query("SELECT o_custkey, array_to_string(list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderkey), ' ') AS rows FROM orders GROUP BY o_custkey")
def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("o_orderkey", "o_orderstatus")
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("o_custkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), " ").alias("rows"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("SELECT count(DISTINCT (l_suppkey, l_linenumber)) AS n_groups FROM lineitem")
def distinct_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey", "l_linenumber").alias("n_groups"))


@query("SELECT 'customer' AS project, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("project"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("project"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s)


# --- archives and logs ------------------------------------------------------------------

_NAME = "CASE WHEN page_id % 5 = 0 THEN 'x' ELSE 'Gson-' END || (page_id % 40) || CASE WHEN page_id % 2 = 0 THEN 'f' ELSE 'b' END || '-generated_test.' || page_id || '.tar.bz2'"


@query(f"""WITH n AS (SELECT page_id, {_NAME} AS name FROM pages), m AS (SELECT *, regexp_matches(name, '^([^-]+)-(\\d+[bf])-([^.]+)\\.(\\d+)?\\.tar\\.bz2$') AS ok FROM n)
SELECT page_id, CASE WHEN ok THEN 'Gson' END AS pid, CASE WHEN ok THEN split_part(name, '-', 2) END AS vid, CASE WHEN ok THEN CAST(regexp_replace(split_part(name, '-', 2), '[^0-9]', '', 'g') AS INTEGER) END AS vid_num,
 CASE WHEN ok THEN 'generated_tests' END AS src, CASE WHEN ok THEN CAST(split_part(name, '.', 2) AS INTEGER) END AS tid FROM m""")
def archive_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    name = F.concat(F.when(key % 5 == 0, "x").otherwise("Gson-"), (key % 40).cast("string"), F.when(key % 2 == 0, "f").otherwise("b"), F.lit("-generated_test."), key.cast("string"), F.lit(".tar.bz2"))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    return rows.select("page_id", *files.archive_parts(F.col("name")))


_LOG = "CASE WHEN o_orderkey % 3 = 0 THEN '[javac] /tmp/a/B' || o_custkey || '.java:' || o_orderkey || ': error: cannot find ' || o_orderpriority || '. x' WHEN o_orderkey % 3 = 1 THEN '[javac] warning: ' || o_orderstatus ELSE 'note ' || o_orderkey END"


@query(f"""WITH l AS (SELECT o_orderkey, o_custkey, o_orderpriority, {_LOG} AS text FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/tmp/a/B' || o_custkey || '.java' END AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'tmp.a.B' || o_custkey END AS class, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS INTEGER) END AS line,
 CASE WHEN o_orderkey % 3 = 0 THEN 'cannot find ' || o_orderpriority END AS message FROM l WHERE NOT regexp_matches(text, 'javac.*warning:')""")
def compile_error_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    line = F.when(key % 3 == 0, F.concat(F.lit("[javac] /tmp/a/B"), F.col("o_custkey").cast("string"), F.lit(".java:"), key.cast("string"), F.lit(": error: cannot find "), "o_orderpriority", F.lit(". x"))).when(key % 3 == 1, F.concat(F.lit("[javac] warning: "), "o_orderstatus")).otherwise(F.concat(F.lit("note "), key.cast("string")))
    rows = files.without_noise(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("text")))
    return rows.select("o_orderkey", *files.compile_error(F.col("text")))


# --- outcomes ---------------------------------------------------------------------------

_FLAGS = ", ".join(f"(event_id * 7 + user_id) % 6 > {i} AS {name}" for i, name in enumerate(outcomes.STAGES))
_RATED = ("syntax_error", "compile_error", "execute_error", "failing_tests", "syntax_correct", "compile_correct", "passing_tests", "correct_tests")


def _summary_sql(conditions: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {conditions[k]}) AS n_{k}, count(*) FILTER (WHERE {conditions[k]}) * 100.0::DOUBLE / count(*) AS rate_{k}" for k in _RATED)


_RIGHT = {"syntax_correct": "correct_syntax", "compile_correct": "compilable", "passing_tests": "passing_test", "correct_tests": "correct_test"}
_SINGLE = {"syntax_error": "NOT correct_syntax", "compile_error": "correct_syntax AND NOT compilable", "execute_error": "compilable AND NOT executable", "failing_tests": "executable AND NOT passing_test", **_RIGHT}
_NESTED = {"syntax_error": "NOT correct_syntax", "compile_error": "NOT compilable", "execute_error": "NOT executable", "failing_tests": "NOT passing_test", **_RIGHT}


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(6))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("project"), *[v.alias(k) for k, v in outcomes.stage_flags(reached).items()])


@query(f"WITH e AS (SELECT event_type AS project, {_FLAGS} FROM events) SELECT project, count(*) AS total_tests, {_summary_sql(_SINGLE)} FROM e GROUP BY project")
def outcome_funnel_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.single_funnel(_outcomes(spark, sf_dir), ["project"])


@query(f"""WITH e AS (SELECT event_id, user_id, event_type AS project, {_FLAGS} FROM events),
m AS (SELECT project, user_id, bool_or(correct_syntax) AS correct_syntax, bool_or(compilable) AS compilable, bool_or(executable) AS executable, bool_or(passing_test) AS passing_test,
 coalesce(arg_min(correct_test, event_id) FILTER (WHERE passing_test), false) AS correct_test FROM e GROUP BY ALL)
SELECT project, count(*) AS total_tests, {_summary_sql(_NESTED)} FROM m GROUP BY project""")
def outcome_funnel_any_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.any_of_k(_outcomes(spark, sf_dir), ["project"], ["user_id"], "event_id")


@query(f"WITH e AS (SELECT event_id, {_FLAGS} FROM events) SELECT event_id, " + ", ".join(f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END AS {c}" for c in outcomes.STAGES) + " FROM e")
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("event_id", *[text.yes_no(F.col(c)).alias(c) for c in outcomes.STAGES])


@query("""WITH c AS (SELECT l_orderkey, count(*) AS lines_total, count(*) FILTER (WHERE l_returnflag <> 'N') AS lines_covered, count(*) FILTER (WHERE l_quantity > 25) AS branches_total,
 count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05) AS branches_covered FROM lineitem GROUP BY l_orderkey)
SELECT *, lines_covered * 100.0::DOUBLE / lines_total AS line_rate, CASE WHEN branches_total = 0 THEN 0.0::DOUBLE ELSE branches_covered * 100.0::DOUBLE / branches_total END AS branch_rate FROM c""")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.coverage(_covered(spark, sf_dir))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.col("l_quantity") > 25
    lines = [F.count("*").alias("lines_total"), F.count_if(F.col("l_returnflag") != "N").alias("lines_covered")]
    branches = [F.count_if(branch).alias("branches_total"), F.count_if(branch & (F.col("l_discount") > 0.05)).alias("branches_covered")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*lines, *branches)


@query("SELECT event_type AS project, count(*) AS n, sum(value) / count(*) AS seconds_each, 1 / nullif(sum(value) / count(*), 0) AS per_second FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("project")).agg(F.count("*").alias("n"), (F.sum("value") / F.count("*")).alias("seconds_each"))
    return each.withColumn("per_second", F.try_divide(F.lit(1.0), "seconds_each")).select("project", "n", F.round("seconds_each", 9).alias("seconds_each"), F.round("per_second", 9).alias("per_second"))


SQL["throughput"] = "SELECT event_type AS project, count(*) AS n, round(sum(value) / count(*), 9) AS seconds_each, round(1 / nullif(sum(value) / count(*), 0), 9) AS per_second FROM events GROUP BY event_type"

# --- similarity -------------------------------------------------------------------------

_GRAMS = " UNION ALL ".join(
    f"SELECT conv_id, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, greatest(len({s}) - {n} + 2, 1)), lambda i: array_to_string({s}[i : i + {n - 1}], ' '))) AS gram FROM p" for n in range(1, 5) for s in "cr"
)


def _against_turn_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn 1 of a conversation is the reference, every other turn a candidate at its position; without a turn 1 the reference is empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.split("text", r"\s+").alias("c"))
    return turns.where("position <> 1").join(turns.where("position = 1").select("conv_id", F.col("c").alias("r")), "conv_id", "left")


_PAIRS = r"""p AS (SELECT a.conv_id, a.turn AS position, string_split_regex(a.text, '\s+') AS c, string_split_regex(b.text, '\s+') AS r FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn <> 1)"""


@query(rf"""WITH {_PAIRS},
g AS ({_GRAMS.replace("SELECT conv_id", "SELECT position, conv_id")}), k AS (SELECT position, conv_id, n, gram, count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY ALL),
s AS (SELECT position, n, sum(least(c, r))::DOUBLE / nullif(sum(c), 0) AS p FROM k GROUP BY position, n),
q AS (SELECT position, coalesce(max(p) FILTER (WHERE n = 1), 0) AS p1, coalesce(max(p) FILTER (WHERE n = 2), 0) AS p2, coalesce(max(p) FILTER (WHERE n = 3), 0) AS p3, coalesce(max(p) FILTER (WHERE n = 4), 0) AS p4 FROM s GROUP BY position),
z AS (SELECT position, sum(len(c))::DOUBLE AS nc, sum(len(r))::DOUBLE AS nr FROM p GROUP BY position)
SELECT position, round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN (CASE WHEN nc >= nr THEN 1 ELSE exp(1 - nr / nc) END) * exp((ln(nullif(p1, 0)) + ln(nullif(p2, 0)) + ln(nullif(p3, 0)) + ln(nullif(p4, 0))) / 4) ELSE 0 END, 9)::DOUBLE AS bleu,
 round(p1, 9)::DOUBLE AS p1, round(p2, 9)::DOUBLE AS p2, round(p3, 9)::DOUBLE AS p3, round(p4, 9)::DOUBLE AS p4, round(nc / nr, 9)::DOUBLE AS length_ratio FROM q JOIN z USING (position)""")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.corpus_bleu(_against_turn_1(spark, sf_dir), "c", "r", by=("position",))
    return rows.select("position", *[F.round(c, 9).alias(c) for c in rows.columns[1:]])


# The keywords that weigh more in a method's unigrams.
JAVA_KEYWORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else", "enum", "extends",
    "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "package", "private",
    "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void",
    "volatile", "while",
)


@query(rf"""WITH {_PAIRS},
g AS ({_GRAMS.replace("SELECT conv_id", "SELECT position, conv_id")}), k AS (SELECT position, conv_id, n, gram, count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY ALL),
w AS (SELECT *, CASE WHEN n > 1 OR gram IN ({", ".join(f"'{k}'" for k in JAVA_KEYWORDS)}) THEN 1.0 ELSE 0.2 END AS weight FROM k),
s AS (SELECT position, n, sum(least(c, r) * weight)::DOUBLE / nullif(sum(c * weight), 0)::DOUBLE AS p FROM w GROUP BY position, n)
SELECT position, {", ".join(f"round(coalesce(max(p) FILTER (WHERE n = {n}), 0), 9)::DOUBLE AS p{n}" for n in range(1, 5))} FROM s GROUP BY position""")
def weighted_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted precisions of every candidate position: keywords weigh more among unigrams, longer n-grams weigh alike."""
    rows = metrics.corpus_bleu(_against_turn_1(spark, sf_dir), "c", "r", dict.fromkeys(JAVA_KEYWORDS, 1.0), by=("position",))
    return rows.select("position", *[F.round(f"p{n}", 9).alias(f"p{n}") for n in range(1, 5)])


# --- files ------------------------------------------------------------------------------


@query("SELECT item_id, text FROM benchmark")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes through CSV and back."""
    path = scratch.folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "benchmark"), path, ("item_id", "text"))
    return files.csv_table(spark, path, "item_id long, text string")


@query("SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark")
def text_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")), path)
    return files.text_lines(spark, path)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "json")
    sinks.write_json(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("SELECT 'c' || conv_id || '.tar.bz2' AS name, 'turn' || turn || '.txt' AS member, md5(text) AS text_md5 FROM conversations")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tar.bz2 for each conversation, unpacked again."""
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".tar.bz2")).alias("name"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))
    path = scratch.folder(spark, "archives")
    sinks.archives(turns).write.parquet(path)
    packed = spark.read.parquet(path)
    return packed.mapInArrow(files.members_of, "name string, member string, content binary").select("name", "member", F.md5("content").alias("text_md5"))


@query("SELECT name, member, md5(text) AS text_md5 FROM (SELECT 'P' || item_id % 7 || '-' || item_id || 'f-generated_test.' || item_id || '.tar.bz2' AS name, 'src/T' || item_id || '.java' AS member, text FROM benchmark)")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tar.bz2 file for each item, found by name and unpacked again."""
    key = F.col("item_id").cast("string")
    name = F.concat(F.lit("P"), F.pmod("item_id", F.lit(7)).cast("string"), F.lit("-"), key, F.lit("f-generated_test."), key, F.lit(".tar.bz2"))
    rows = table(spark, sf_dir, "benchmark").select(name.alias("name"), F.concat(F.lit("src/T"), key, F.lit(".java")).alias("member"), F.col("text").cast("binary").alias("content"))
    path = scratch.folder(spark, "archives")
    sinks.write_files(sinks.archives(rows).select(F.col("name").alias("path"), "content"), path)
    return files.archive_members(spark, path).select("name", "member", F.md5("content").alias("text_md5"))


@query("""SELECT 'P-' || doc_id % 41 || 'f-generated_test.' || doc_id % 41 || '.tar.bz2' AS name, 'src/T' || doc_id || '.java' AS member, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents""")
def archives_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into archives of very many members, written as they come and read as they are unpacked."""
    key, part = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(41)).cast("string")
    name = F.concat(F.lit("P-"), part, F.lit("f-generated_test."), part, F.lit(".tar.bz2"))
    rows = table(spark, sf_dir, "documents").select(name.alias("name"), F.concat(F.lit("src/T"), key, F.lit(".java")).alias("member"), F.col("text").cast("binary").alias("content"))
    path = scratch.folder(spark, "archives")
    archives.write_archives(rows, path)
    return archives.read_archives(spark, path).select("name", "member", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("text_md5"))


@query("""WITH a AS (SELECT item_id, item_id % 40 AS v, item_id % 3 AS sid FROM benchmark)
SELECT 'P-' || v || 'f-generated_test.' || item_id || '.' || sid || '.tar.bz2' AS name, 'P' AS pid, v || 'f' AS vid, v::INTEGER AS vid_num, 'generated_tests' AS src, item_id::INTEGER AS tid, sid::INTEGER AS sid,
 row_number() OVER (ORDER BY v, item_id, sid) - 1 AS place FROM a""")
def archive_listing_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of k candidates found in a folder, in their order; other files there are passed over."""
    key = F.col("item_id")
    name = F.concat(F.lit("P-"), F.pmod(key, F.lit(40)).cast("string"), F.lit("f-generated_test."), key.cast("string"), F.lit("."), F.pmod(key, F.lit(3)).cast("string"), F.lit(".tar.bz2"))
    path = scratch.folder(spark, "listing")
    both = table(spark, sf_dir, "benchmark").select(F.explode(F.array(name, F.concat(key.cast("string"), F.lit(".txt")), F.concat(F.lit("x"), key.cast("string"), F.lit(".tar.bz2")))).alias("path"), F.lit("").alias("content"))
    sinks.write_files(both, path)
    found = files.archive_listing(spark, path, of_k=True)
    return order.ranked(found, "vid_num", "tid", "sid", name="place")


@query("SELECT r_name AS project, n_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey")
def csv_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV for each project, read together."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    path = scratch.folder(spark, "projects")
    sinks.write_csv(rows.select(F.col("r_name").alias("project"), "n_name", "n_nationkey"), path, by="project")
    return files.csv_table(spark, path, "n_name string, n_nationkey int, project string").select("project", "n_name", "n_nationkey")


_ONE_LINE = "replace(replace(text, chr(10), ' '), chr(13), ' ')"


def _one_line() -> Column:
    return F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


@query(f"SELECT row_number() OVER (ORDER BY item_id, text) - 1 AS line_no, {_ONE_LINE} AS method, 'assert ' || item_id AS statement FROM benchmark WHERE text IS NOT NULL")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of lines in one order, written by many tasks, and paired by line number."""
    rows = table(spark, sf_dir, "benchmark").where("text is not null").orderBy("item_id", "text")
    path = scratch.folder(spark, "pairs")
    sinks.write_lines(rows.select(_one_line().alias("text")), f"{path}/methods")
    sinks.write_lines(rows.select(F.concat(F.lit("assert "), F.col("item_id").cast("string")).alias("text")), f"{path}/asserts")
    return files.paired_lines(spark, f"{path}/methods", f"{path}/asserts").withColumnsRenamed({"left": "method", "right": "statement"})


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, item_id FROM benchmark), p AS (SELECT item_id, unnest(range(3)) AS j FROM benchmark)
SELECT i.line_no, i.item_id, j::INTEGER AS cand_pos, 'p' || p.item_id || '.' || j AS code FROM i JOIN p ON p.item_id = i.item_id""")
def predictions_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictions follow one another for each input; place alone tells whose they are."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    inputs = order.ranked(items, "item_id", name="line_no")
    made = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    flat = order.ranked(made, "item_id", "j", name="line_no")
    flat = flat.select("line_no", F.concat(F.lit("p"), F.col("item_id").cast("string"), F.lit("."), F.col("j").cast("string")).alias("code"))
    return joins.by_position(inputs, flat, 3).select("line_no", "item_id", "cand_pos", "code")


@query("SELECT 'a/' || item_id || '.java' AS path_focal_class, (item_id % 5) || 'f' AS version, item_id::INTEGER AS number_method_by_version, text AS src FROM benchmark")
def corpus_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document in a folder of its own for each item, its version and number read from the path."""
    key = F.col("item_id").cast("string")
    path = F.concat(F.pmod("item_id", F.lit(5)).cast("string"), F.lit("f/methods/"), key, F.lit("/corpus.json"))
    content = F.to_json(F.struct(F.concat(F.lit("a/"), key, F.lit(".java")).alias("path_focal_class"), F.col("text").alias("src")))
    folder = scratch.folder(spark, "corpus")
    sinks.write_files(table(spark, sf_dir, "benchmark").select(path.alias("path"), content.alias("content")), folder)
    return files.corpus_json(spark, folder).select("path_focal_class", "version", "number_method_by_version", "src")


@query("SELECT DISTINCT 'org.' || replace(p_type, ' ', '.') AS class_name FROM part")
def class_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "classes")
    sinks.write_lines(table(spark, sf_dir, "part").select(F.concat(F.lit("org."), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit(" ")).alias("text")), path)
    return files.class_list(spark, path)


@query("SELECT p_brand AS project, array_to_string(list(DISTINCT 'org.' || replace(p_name, ' ', '.') ORDER BY 'org.' || replace(p_name, ' ', '.')), ',') AS classes FROM part GROUP BY p_brand")
def class_catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of projects with their classes, a file for each brand; the last class of each ends in a line break there."""
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.concat(F.lit("org."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("c")).distinct()
    each = named.groupBy("project").agg(F.array_sort(F.collect_list("c")).alias("c"))
    ended = F.transform("c", lambda x, i: F.when(i == F.size("c") - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    content = F.to_json(F.array(F.struct("project", ended.alias("classes"))))
    path = scratch.folder(spark, "catalogue")
    sinks.write_files(each.select(F.concat(F.md5("project"), F.lit(".json")).alias("path"), content.alias("content")), path)
    return files.class_catalogue(spark, path).select("project", F.array_join("classes", ",").alias("classes"))


@query("SELECT 'documents: ' || count(*) || chr(10) AS content FROM documents")
def string_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single text to a file; the second takes the place of the first."""
    path = f"{scratch.folder(spark, 'string')}/summary.txt"
    for content in ("an older and longer text " * 9, f"documents: {table(spark, sf_dir, 'documents').count()}\n"):
        sinks.write_string(spark, content, path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


@query("SELECT 'T' || item_id || '_ESTest' AS class, len(string_split(text, chr(10))) AS n_lines, md5(text) AS text_md5 FROM benchmark WHERE text IS NOT NULL AND text <> ''")
def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited sources to files of a tree, found again; scaffoldings and other files are passed over."""
    key = F.col("item_id").cast("string")
    kinds = F.explode(F.array(*map(F.lit, ("_ESTest.java", "_ESTest_scaffolding.java", ".txt")))).alias("kind")
    rows = table(spark, sf_dir, "benchmark").where("text is not null and text <> ''").select("text", key.alias("key"), kinds)
    folder = scratch.folder(spark, "sources")
    sinks.write_files(rows.select(F.concat(F.lit("src/p"), F.right("key", F.lit(1)), F.lit("/T"), "key", "kind").alias("path"), F.col("text").alias("content")), folder)
    return files.java_sources(spark, folder).select(text.base_name(F.col("path")).alias("class"), F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("text_md5"))


_SUFFIX = "CASE p_size % 3 WHEN 0 THEN '_ESTest.java' WHEN 1 THEN '_ESTest_scaffolding.java' ELSE '.java' END"


@query(f"SELECT p_partkey, 'out/' || replace(p_type, ' ', '$') || {_SUFFIX} AS path FROM part WHERE p_size % 3 <> 2")
def test_class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose name begins with the name of their test class; the class's signs mean themselves."""
    name, rest = F.replace("p_type", F.lit(" "), F.lit("$")), F.pmod("p_size", F.lit(3))
    path = F.concat(F.lit("out/"), name, F.when(rest == 0, "_ESTest.java").when(rest == 1, "_ESTest_scaffolding.java").otherwise(".java"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), text.test_class(name).alias("test_class"))
    return files.of_test_class(rows, "path", F.col("test_class")).select("p_partkey", "path")


@query("SELECT event_id AS test_id, user_id % 97 AS version_num, row_number() OVER (ORDER BY user_id % 97, event_id) - 1 AS place FROM events")
def outcomes_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by version and test, with their place in that order."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("test_id"), F.pmod("user_id", F.lit(97)).alias("version_num"))
    return outcomes.ordered(order.ranked(rows, "version_num", "test_id", name="place"))


@query("""WITH n AS (SELECT p_partkey, p_size, 'P-' || p_size || 'f-scaffolding.tar.bz2' AS name FROM part) SELECT p_partkey, p_size AS version, name FROM n""")
def scaffold_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's archive, found by project and version; a method without one would raise."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit("P").alias("project"), F.col("p_size").alias("version"))
    listing = part.select("project", "version").distinct().withColumn("name", F.concat(F.lit("P-"), F.col("version").cast("string"), F.lit("f-scaffolding.tar.bz2")))
    return joins.with_archive(part, listing, "project", "version").select("p_partkey", "version", "name")


_METHODS = {
    "id": "'P_' || p_partkey", "project": "'P'", "version": "p_size", "number_method_by_version": "p_partkey", "modified_class": "'org.' || replace(p_type, ' ', '.')", "focal_class": "p_brand",
    "path_focal_class_in_project": "'src/' || p_partkey", "test_class": "p_brand || '_ESTest'", "path_test_class_scaffolding": "'t/' || p_partkey", "package_focal_class": "'org'", "imports_focal_class": "p_name",
    "src_fm_fc_ms_ff": "'say \"' || p_name || '\",' || chr(10) || p_size", "src_fm_fc_dctx": "p_name", "src_fm_fc_dctx_priv": "p_brand",
}


@query("SELECT " + ", ".join(f"CAST({v} AS VARCHAR) AS {k}" for k, v in _METHODS.items()) + " FROM part")
def methods_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods table to CSV and back, from columns in another order."""
    sql = {k: v.replace("chr(10)", "'\\n'") for k, v in reversed(_METHODS.items())}
    path = scratch.folder(spark, "methods")
    sinks.write_methods(table(spark, sf_dir, "part").selectExpr(*[f"CAST({v} AS STRING) AS {k}" for k, v in sql.items()]), path)
    return files.csv_table(spark, path)


def _percent_sql(part: str, whole: str) -> str:
    hundredths = f"(({part}) * 20000 + {whole}) // (2 * {whole})"
    return f"CASE WHEN {whole} = 0 THEN '0.00' ELSE {hundredths} // 100 || '.' || lpad(({hundredths} % 100)::VARCHAR, 2, '0') END"


@query(f"""WITH c AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (WHERE l_returnflag <> 'N') AS c, count(*) FILTER (WHERE l_quantity > 25) AS bt, count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05) AS bc FROM lineitem GROUP BY l_orderkey)
SELECT 'n' || l_orderkey AS name, t::VARCHAR AS lines_total, c::VARCHAR AS lines_covered, {_percent_sql("c", "t")} AS line_rate, {_percent_sql("bc", "bt")} AS branch_rate FROM c""")
def coverage_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage to CSV, rates with two decimals."""
    counts = _covered(spark, sf_dir)
    rows = counts.select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("name"), F.lit("P").alias("project"), F.lit("1f").alias("version"), F.lit(1).alias("test_id"), *counts.columns[1:])
    path = scratch.folder(spark, "coverage")
    sinks.write_coverage(outcomes.coverage(rows), path)
    return files.csv_table(spark, path).select("name", "lines_total", "lines_covered", "line_rate", "branch_rate")


@query(f"WITH e AS (SELECT event_id, event_type, {_FLAGS} FROM events) SELECT 'n' || event_id AS name, event_type AS project, '1f' AS version, event_id::VARCHAR AS test_id, " + ", ".join(f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END AS {c}" for c in outcomes.STAGES) + " FROM e")
def outcomes_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes to CSV as Yes and No, in the report's order of columns."""
    key = F.col("event_id")
    rows = _outcomes(spark, sf_dir).withColumns({"name": F.concat(F.lit("n"), key.cast("string")), "version": F.lit("1f"), "test_id": key})
    path = scratch.folder(spark, "outcomes")
    sinks.write_outcomes(rows, path)
    return files.csv_table(spark, path)


@query("WITH e AS (SELECT event_type AS project, count(*)::VARCHAR AS total_tests FROM events GROUP BY 1) SELECT * FROM e UNION ALL SELECT * FROM e")
def summary_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written twice: appended rows stand twice."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("project")).agg(F.count("*").alias("total_tests"))
    path = scratch.folder(spark, "summary")
    for _ in range(2):
        sinks.write_summary(rows, path, append=True)
    return spark.read.option("header", True).csv(path).select("project", "total_tests")


@query("SELECT p_partkey AS key, p_type AS name FROM part WHERE p_type <> '' UNION ALL SELECT s_suppkey, s_name FROM supplier")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table cached by its content, asked for again when its input has grown: the old rows aren't served."""
    grown, cache = scratch.folder(spark, "grown"), scratch.folder(spark, "cache")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("name")).write.parquet(grown)
    read = lambda: spark.read.parquet(grown).where("name <> ''")
    before = files.cached_by_content(cache, read())
    if files.cached_by_content(cache, read()).inputFiles() != before.inputFiles():
        raise ValueError("the table was made again")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).write.mode("append").parquet(grown)
    return files.cached_by_content(cache, read())


@query("SELECT p_type AS chosen, p_partkey FROM part")
def column_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column named at run time; one that isn't there raises."""
    return columns.chosen(table(spark, sf_dir, "part"), "p_type", "p_partkey").withColumnRenamed("p_type", "chosen")


@query("SELECT o_orderkey, o_orderkey % 6 < 3 AS flag FROM orders")
def parsed_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("Yes", "ON", "1", "n", "False", "off")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parsed_boolean(F.get(words, F.pmod("o_orderkey", F.lit(6)).cast("int"))).alias("flag"))


# --- extension --------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extension's windows over the whole table."""
    found = windows.windowed_counts(table(spark, sf_dir, "events"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


# --- Java text --------------------------------------------------------------------------


#: Quotes and backslashes would end the literal that holds the text.
_LITERAL = """replace(translate(text, '"\\', ''), chr(10), ' ')"""


@query(f"""WITH d AS (SELECT doc_id, {_LITERAL} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, doc_id % 6 = 0 AS whole, ' void check' || doc_id || '() {{ int a = f("' || t || '"' || CASE WHEN doc_id % 2 = 0 THEN ');' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END
 || CASE WHEN doc_id % 2 = 0 THEN '' WHEN doc_id % 3 = 0 THEN ');' ELSE ');' END || '}}' AS body FROM d)
SELECT doc_id, NOT whole AS had_errors, false AS has_errors, 'check' || doc_id AS method, md5('@Test public void testCheck' || doc_id || substr(body, 12 + length(doc_id::VARCHAR))) AS adapted_md5, md5('/* x */  ' || body) AS bare_md5,
 md5('/* x */ @Test(expected = A.class)' || body) AS code_md5 FROM c""")
def java_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Java functions over documents put into a method's body as a literal, with and without the ends of its call and its block."""
    tasks.small_batches(spark)
    key = F.col("doc_id")
    literal = F.replace(F.translate("text", '"\\', ""), F.lit("\n"), F.lit(" "))
    code = F.concat(F.lit("/* x */ @Test(expected = A.class) void check"), key.cast("string"), F.lit('() { int a = f("'), literal, F.lit('"'), F.when(key % 2 == 0, ");").otherwise(""), F.when(key % 3 == 0, " }").otherwise(""))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", javasrc.mended(code).alias("m"))
    digests = [F.md5(F.col(f"m.{c}")).alias(f"{c}_md5") for c in ("adapted", "bare", "code")]
    return rows.select("doc_id", "m.had_errors", "m.has_errors", "m.method", *digests)


_BARE = "translate(text, '*/\"''\\' || chr(10), '')"


@query(f"""WITH d AS (SELECT doc_id, {_BARE} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5('int a;   String s = "' || t || '";  ' || chr(10) || 'int b;  ') AS bare_md5 FROM d""")
def java_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of either kind around each document, which also stands in a literal."""
    tasks.small_batches(spark)
    bare = F.translate("text", "*/\"'\\\n", "")
    code = F.concat(F.lit("int a; /* "), bare, F.lit(' */ String s = "'), bare, F.lit('"; // '), bare, F.lit("\nint b; // end"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(javasrc.clean_comments(code)).alias("bare_md5"))


# --- queries in modules of their own ----------------------------------------------------

from quarryloom.plans import code as _code  # noqa: E402, F401
