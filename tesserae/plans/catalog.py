"""Registered queries of the retrieval operators, each with its SQL.

The collection is documents and embeddings, joined in full on their ids, in the SQL too: a document may have no vector, and
a vector no document. Labels are metadata that may be absent; vectors are scaled by 1 + id % 7, lest all metrics rank alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import Metric
from ..functions.filters import compile_filter
from ..functions.quantize import codes, restored, symmetric_distance
from ..functions.schema import metadata
from ..operators import ann, bm25, evaluate, search
from ..functions.text import STOP_WORDS
from ..sources.scratch import materialize, new_path
from ..sources.store import VectorDB, deletion_ratio, integrity, memory_estimate, partial_update, replay, upsert
from ..streaming import replica
from . import access, observe

TEXT = "the hand of thing and er on the thing"
WORDS = "that it was on thing"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def collection(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 7).cast("float")).cast("float")).alias("embedding"))
    rows = read(spark, sf, "documents").join(e, "doc_id", "full").join(read(spark, sf, "labels"), "doc_id", "left")
    meta = metadata(
        lang=("s", F.col("lang")), source=("s", F.col("source")), n_chars=("i", F.col("n_chars")), quality=("i", F.col("quality")),
        toxic=("i", F.col("toxic")), kilo=("f", F.col("n_chars") / 1000.0), long=("b", F.col("n_chars") > 1500),
    )
    return rows.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), "text", "embedding", meta.alias("metadata"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The collection's texts, for queries that ask for no more: no join moves them."""
    return read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("seq"), "text")


def query_vector(spark: SparkSession, sf: str, vec_id: int = 3) -> list[float]:
    return list(read(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


_C = """c AS (SELECT coalesce(d.doc_id, e.vec_id) AS seq, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, d.n_chars / 1000.0::DOUBLE AS kilo, d.n_chars > 1500 AS long,
  list_transform(e.embedding, lambda x: CAST(x * CAST(1 + e.vec_id % 7 AS FLOAT) AS FLOAT)) AS fv,
  list_transform(e.embedding, lambda x: CAST(CAST(x * CAST(1 + e.vec_id % 7 AS FLOAT) AS FLOAT) AS DOUBLE)) AS v
  FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON coalesce(d.doc_id, e.vec_id) = l.doc_id),
cv AS (SELECT * FROM c WHERE fv IS NOT NULL), ct AS (SELECT * FROM c WHERE text IS NOT NULL),
q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 3)"""
_SIM = {"cosine": "list_cosine_similarity(v, q)", "euclidean": "1 - list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "dot_product": "1 + list_inner_product(v, q)"}
_RESTORE = """k AS (SELECT *, list_min(fv) AS mn, list_max(fv) AS mx, CAST(list_max(fv) - list_min(fv) AS FLOAT) AS span FROM cv),
z AS (SELECT *, CASE WHEN span < CAST(1.1920928955078125e-07 AS FLOAT) THEN CAST(0 AS FLOAT) ELSE CAST(span / CAST(255 AS FLOAT) AS FLOAT) END AS sc,
  CASE WHEN span < CAST(1.1920928955078125e-07 AS FLOAT) THEN list_transform(fv, lambda x: 128) ELSE list_transform(fv, lambda x: CAST(least(255.0, floor(CAST(CAST((x - mn) * CAST(CAST(255 AS FLOAT) / span AS FLOAT) AS FLOAT) AS DOUBLE) + 0.5)) AS INTEGER)) END AS codes FROM k),
r AS (SELECT *, list_transform(codes, lambda x: CAST(CAST(mn + CAST(CAST(x AS FLOAT) * sc AS FLOAT) AS FLOAT) AS DOUBLE)) AS rv FROM z)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 1 AND NOT list_contains([{_STOP}], t))"


def _vec_sql(metric="cosine", where="true", k=10, tail="", extra="") -> str:
    return f"WITH {_C} SELECT seq, round(score, 6) AS score FROM (SELECT seq, {_SIM[metric]} AS score FROM cv, q WHERE {where} ORDER BY score DESC, seq DESC LIMIT {k} {extra}) {tail}"


def _bm_ctes(text: str, where: str = "true") -> str:
    return f"""t AS (SELECT seq, {_toks("text")} AS w FROM ct),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t),
qt AS (SELECT t AS term, count(*) AS qtf FROM (SELECT unnest({_toks("'" + text + "'")}) AS t) GROUP BY t),
tf AS (SELECT seq, dl, term, count(*) AS tf FROM (SELECT seq, len(w) AS dl, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY seq, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT seq, list_reduce(list_sort(list(qtf * (ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))))), lambda a, b: a + b) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (term), n WHERE seq IN (SELECT seq FROM c WHERE {where}) GROUP BY seq)"""


def _bm_sql(text: str, where: str | None = None, pre: str = "true", k: int = 10) -> str:
    tail = f"WHERE seq IN (SELECT seq FROM c WHERE {where})" if where else ""
    return f"WITH {_C}, {_bm_ctes(text, pre)} SELECT seq, round(score, 6) AS score FROM (SELECT * FROM bm ORDER BY score DESC, seq DESC LIMIT {k}) {tail}"


_EN = {"must": [{"field": "lang", "op": "eq", "value": "en"}]}


def _hyb_sql(method: str, alpha: float = 0.7, k: int = 10, where: str = "true", minimum: float | None = None, sides: str = "both") -> str:
    v = f"v AS (SELECT seq, {_SIM['cosine']} AS score FROM cv, q WHERE {where} ORDER BY score DESC, seq DESC LIMIT {0 if sides == 'text' else k})"
    w = f"w AS (SELECT * FROM (SELECT * FROM bm ORDER BY score DESC, seq DESC LIMIT {0 if sides == 'vector' else k}) WHERE seq IN (SELECT seq FROM c WHERE {where}))"
    if method == "rrf":
        fused = """SELECT seq, list_reduce(list_sort(list(p)), lambda a, b: a + b) AS score FROM (
          SELECT seq, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY score DESC, seq DESC)) AS p FROM v UNION ALL
          SELECT seq, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY score DESC, seq DESC)) FROM w) GROUP BY seq"""
    else:
        s = "SELECT seq, CASE WHEN max(score) OVER () - min(score) OVER () < 1.1920928955078125e-07 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM"
        fused = f"SELECT seq, {alpha}::DOUBLE * coalesce(x.s, 0) + {1 - alpha}::DOUBLE * coalesce(y.s, 0) AS score FROM ({s} v) x FULL JOIN ({s} w) y USING (seq)"
    tail = "" if minimum is None else f"WHERE score >= {minimum}"
    return f"WITH {_C}, {_bm_ctes(TEXT)}, {v}, {w}, f AS ({fused}) SELECT seq, round(score, 6) AS score FROM (SELECT * FROM f ORDER BY score DESC, seq DESC LIMIT {k}) {tail}"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _vec(**kw):
    return lambda s, d: rounded(search.vector_search(collection(s, d), query_vector(s, d), **kw))


for _m in ("cosine", "euclidean", "dot_product"):
    _short = _m.replace("_product", "")
    _add(f"vec_{_short}_topk", _vec(metric=_m), _vec_sql(_m))
    _compact = {"cosine": "CASE WHEN sc = 0 THEN 0 ELSE list_cosine_similarity(rv, q) END", "euclidean": _SIM["euclidean"].replace("(v,", "(rv,"), "dot_product": "1 + list_inner_product(rv, q)"}[_m]
    _add(f"vec_compact_{_short}_topk", _vec(metric=_m, mode="compact"), f"WITH {_C}, {_RESTORE} SELECT seq, round(score, 6) AS score FROM (SELECT seq, {_compact} AS score FROM r, q ORDER BY score DESC, seq DESC LIMIT 10)")
_add("vec_filtered_topk", _vec(where=_EN), _vec_sql(where="lang = 'en'"))
_add("vec_min_similarity", _vec(k=50, min_similarity=0.2), _vec_sql(k=50, tail="WHERE score >= 0.2"))


def _batch(s, d):
    q = read(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(search.batch_search(collection(s, d), q, 5))


_add("vec_batch_topk", _batch, f"""WITH {_C} SELECT query_id, seq, round(score, 6) AS score FROM (
SELECT query_id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq DESC) AS n FROM (
SELECT vec_id AS query_id, seq, list_cosine_similarity(v, list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS score FROM cv, embeddings)) WHERE n <= 5""")


def _symmetric(s, d):
    c = collection(s, d).where("embedding is not null").select("seq", codes(F.col("embedding")).alias("q"))
    base = F.broadcast(c.where("seq = 3").select(F.col("q").alias("p")))
    each = [F.round(symmetric_distance(m, F.col("p"), F.col("q")), 4).alias(m.value) for m in Metric]
    return c.crossJoin(base).select("seq", *each)


_add("vec_symmetric_u8_distances", _symmetric, f"""WITH {_C}, {_RESTORE}, e AS (SELECT seq, sc, list_transform(codes, lambda x: CAST(mn AS DOUBLE) + x * CAST(sc AS DOUBLE)) AS x FROM r), p AS (SELECT x AS y, sc AS s2 FROM e WHERE seq = 3)
SELECT seq, round(1 - CASE WHEN sc = 0 OR s2 = 0 THEN 0 ELSE list_cosine_similarity(x, y) END, 4) AS cosine, round(list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 4) AS euclidean, round(-list_inner_product(x, y), 4) AS dot_product FROM e, p""")
_add("quantize_codes", lambda s, d: collection(s, d).select("seq", codes(F.col("embedding")).alias("q")).select("seq", F.posexplode("q.codes").alias("i", "code")).select("seq", "i", F.col("code").cast("int").alias("code")),
     f"WITH {_C}, {_RESTORE} SELECT seq, CAST(i - 1 AS INTEGER) AS i, CAST(codes[i] AS INTEGER) AS code FROM (SELECT seq, codes, unnest(range(1, len(codes) + 1)) AS i FROM r)")
_add("dequantize_values", lambda s, d: collection(s, d).select("seq", restored(codes(F.col("embedding"))).alias("v")).select("seq", F.posexplode("v").alias("i", "x")).select("seq", "i", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x")),
     f"WITH {_C}, {_RESTORE} SELECT seq, CAST(i - 1 AS INTEGER) AS i, round(rv[i], 5) + 0.0 AS x FROM (SELECT seq, rv, unnest(range(1, len(rv) + 1)) AS i FROM r)")

_FILTERS: dict[str, tuple[dict, str]] = {
    "flt_eq_string": (_EN, "lang = 'en'"),
    "flt_eq_int_float_cross": ({"must": [{"field": "quality", "op": "eq", "value": 1.0}]}, "quality = 1"),
    "flt_eq_bool": ({"must": [{"field": "long", "op": "eq", "value": True}]}, "long"),
    "flt_ne_missing_field": ({"must": [{"field": "quality", "op": "ne", "value": 1}]}, "quality <> 1"),
    "flt_ne_type_mismatch": ({"must": [{"field": "lang", "op": "ne", "value": 5}]}, "lang IS NOT NULL"),
    "flt_gt": ({"must": [{"field": "n_chars", "op": "gt", "value": 1500}]}, "n_chars > 1500"),
    "flt_lt": ({"must": [{"field": "kilo", "op": "lt", "value": 1}]}, "kilo < 1"),
    "flt_gte": ({"must": [{"field": "kilo", "op": "gte", "value": 2.5}]}, "kilo >= 2.5"),
    "flt_lte": ({"must": [{"field": "toxic", "op": "lte", "value": 0}]}, "toxic <= 0"),
    "flt_order_of_string": ({"must": [{"field": "lang", "op": "gt", "value": 1}]}, "false"),
    "flt_in": ({"must": [{"field": "source", "op": "in", "values": ["src1", "src2", 7]}]}, "source IN ('src1', 'src2')"),
    "flt_must_not": ({"must_not": [{"field": "quality", "op": "eq", "value": 1}]}, "NOT coalesce(quality = 1, false)"),
    "flt_combined": ({"must": [{"field": "lang", "op": "in", "values": ["en", "de"]}, {"field": "n_chars", "op": "gt", "value": 500}], "must_not": [{"field": "toxic", "op": "eq", "value": 1}]}, "lang IN ('en', 'de') AND n_chars > 500 AND NOT coalesce(toxic = 1, false)"),
}
for _name, (_clause, _sql) in _FILTERS.items():
    _add(_name, lambda s, d, c=_clause: collection(s, d).where(compile_filter(c)).select("seq"), f"WITH {_C} SELECT seq FROM c WHERE {_sql}")

_add("txt_tokens", lambda s, d: bm25.doc_terms(texts(s, d)).select("seq", F.posexplode("terms").alias("i", "term")), f"WITH {_C} SELECT seq, CAST(i - 1 AS INTEGER) AS i, w[i] AS term FROM (SELECT seq, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT seq, {_toks('text')} AS w FROM ct))")
_add("txt_doc_lengths", lambda s, d: bm25.lengths(texts(s, d)), f"WITH {_C} SELECT seq, CAST(len({_toks('text')}) AS INTEGER) AS dl FROM ct")
_add("txt_postings", lambda s, d: bm25.postings(texts(s, d)), f"WITH {_C} SELECT term, seq, CAST(count(*) AS INTEGER) AS tf FROM (SELECT seq, unnest({_toks('text')}) AS term FROM ct) GROUP BY term, seq")
_add("txt_df_idf", lambda s, d: bm25.document_frequency(texts(s, d)).withColumn("idf", F.round("idf", 6)), f"WITH {_C} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(DISTINCT seq) AS df FROM (SELECT seq, unnest({_toks('text')}) AS term FROM ct) GROUP BY term), (SELECT count(*) AS n FROM ct)")
_add("txt_bm25_topk", lambda s, d: rounded(search.keyword_search(texts(s, d), WORDS)), _bm_sql(WORDS))
_add("txt_bm25_duplicate_terms", lambda s, d: rounded(search.keyword_search(texts(s, d), TEXT)), _bm_sql(TEXT))
_add("txt_bm25_postfilter", lambda s, d: rounded(search.keyword_search(collection(s, d), TEXT, where={"must": [{"field": "source", "op": "in", "values": ["src1", "src2", "src3", "src4"]}]})), _bm_sql(TEXT, "source IN ('src1', 'src2', 'src3', 'src4')"))
_add("txt_bm25_prefilter", lambda s, d: rounded(search.keyword_search(collection(s, d), TEXT, where={"must": [{"field": "source", "op": "in", "values": ["src1", "src2"]}]}, prefilter=True)), _bm_sql(TEXT, pre="source IN ('src1', 'src2')"))
_add("txt_empty_query", lambda s, d: rounded(search.keyword_search(collection(s, d), "the of a")), f"WITH {_C} SELECT seq, 0.0::DOUBLE AS score FROM c WHERE false")


def _hyb(**kw):
    sides = kw.pop("sides", "both")
    return lambda s, d: rounded(search.hybrid_search(collection(s, d), None if sides == "text" else query_vector(s, d), None if sides == "vector" else TEXT, **kw))


_add("hyb_rrf", _hyb(), _hyb_sql("rrf"))
_add("hyb_linear", _hyb(method="linear"), _hyb_sql("linear"))
_add("hyb_linear_alpha0", _hyb(method="linear", alpha=0.0), _hyb_sql("linear", 0.0))
_add("hyb_linear_alpha1", _hyb(method="linear", alpha=1.0), _hyb_sql("linear", 1.0))
_add("hyb_filtered", _hyb(method="linear", where=_EN), _hyb_sql("linear", where="lang = 'en'"))
_add("hyb_min_similarity", _hyb(k=40, min_similarity=0.0135), _hyb_sql("rrf", k=40, minimum=0.0135))
_add("hyb_one_sided", _hyb(sides="vector"), _hyb_sql("rrf", sides="vector"))
_add("hyb_text_only", _hyb(sides="text", method="linear"), _hyb_sql("linear", sides="text"))
_PAGE = f"SELECT seq, score, row_number() OVER (ORDER BY score DESC, seq DESC) AS rank FROM (SELECT seq, {_SIM['cosine']} AS score FROM cv, q ORDER BY score DESC, seq DESC LIMIT 25)"
_add("page_offset", lambda s, d: rounded(search.search(collection(s, d), query_vector(s, d), k=10, offset=15)), f"WITH {_C}, w AS ({_PAGE}) SELECT seq, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM w WHERE rank > 15")


def _counts(s, d):
    window = search.search(collection(s, d), query_vector(s, d), k=25)
    return window.agg(F.count_if(F.col("rank") > 15).alias("count"), F.count("*").alias("total"))


_add("page_counts", _counts, f"WITH {_C}, w AS ({_PAGE}) SELECT count(*) FILTER (rank > 15) AS count, count(*) AS total FROM w")

_add("doc_get", lambda s, d: collection(s, d).where(F.col("id") == "42").select("id", "text"), f"WITH {_C} SELECT CAST(seq AS VARCHAR) AS id, text FROM c WHERE seq = 42")
_gone = lambda s, d: read(s, d, "events").where("event_type = 'purchase'").select((F.col("event_id") % 1000).cast("string").alias("id")).distinct()
_GONE = "(SELECT DISTINCT event_id % 1000 FROM events WHERE event_type = 'purchase')"
_add("doc_delete", lambda s, d: collection(s, d).join(_gone(s, d), "id", "left_anti").select("seq"), f"WITH {_C} SELECT seq FROM c WHERE seq NOT IN {_GONE}")


def _flag(name: str, value: int):
    return F.coalesce(F.col("metadata")[name]["i"] == value, F.lit(False))


def _changes(s, d) -> DataFrame:
    """Documents of bad quality with a longer text, and toxic ones once more, numbered from a million."""
    c = collection(s, d)
    old = c.where(_flag("quality", 0)).withColumn("text", F.concat(F.lit("changed: "), "text"))
    new = c.where(_flag("toxic", 1)).withColumn("id", (F.col("seq") + 1_000_000).cast("string")).withColumn("seq", F.col("seq") + 1_000_000)
    return old.unionByName(new)


_add("doc_upsert", lambda s, d: upsert(collection(s, d), _changes(s, d)).select("id", "text"), f"""WITH {_C} SELECT CAST(seq AS VARCHAR) AS id, CASE WHEN quality = 0 THEN 'changed: ' || text ELSE text END AS text FROM c
UNION ALL SELECT CAST(seq + 1000000 AS VARCHAR), text FROM c WHERE toxic = 1""")


def _partial(s, d):
    c = collection(s, d)
    new = c.where(_flag("quality", 1)).select("id", F.lit("new text").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast(c.schema["metadata"].dataType).alias("metadata"))
    return partial_update(c, new).select("id", "text", F.size("embedding").alias("dim"))


_add("doc_partial_update", _partial, f"WITH {_C} SELECT CAST(seq AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'new text' ELSE text END AS text, CAST(len(fv) AS INTEGER) AS dim FROM c")


def _log(s, d) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "update").otherwise("insert")
    return read(s, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("map<string,struct<b:boolean,i:bigint,f:double,s:string>>").alias("metadata"))


_add("log_replay", lambda s, d: replay(_log(s, d)).select("id", "seq", "text"), """SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, props AS text FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'purchase'""")


def _stats(s, d):
    c = collection(s, d).withColumn("deleted", _flag("quality", 0))
    return c.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"), F.max(F.size("embedding")).alias("dimension"))


_add("col_stats", _stats, f"WITH {_C} SELECT count(*) FILTER (quality IS DISTINCT FROM 0) AS live, count(*) FILTER (quality = 0) AS deleted, CAST(max(len(fv)) AS INTEGER) AS dimension FROM c")
_add("col_memory_estimate", lambda s, d: memory_estimate(collection(s, d)), f"""WITH {_C}, t AS (SELECT term, count(DISTINCT seq) AS df FROM (SELECT seq, unnest({_toks('text')}) AS term FROM ct) GROUP BY term)
SELECT CAST((SELECT sum(coalesce(len(fv), 0) + 8 + 2 + 4 + coalesce(strlen(text), 0) + 16 + 64 * ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (kilo IS NOT NULL)::INT + (long IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT
  + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) + 64 + 24 + 16) FROM c) + (SELECT sum(strlen(term) + 24 + 8 * df + 24) FROM t) AS BIGINT) AS bytes""")
_add("col_deletion_ratio", lambda s, d: deletion_ratio(collection(s, d).withColumn("deleted", _flag("quality", 0))), f"WITH {_C} SELECT (count(*) FILTER (quality = 0))::DOUBLE / count(*) AS ratio FROM c")
_add("col_scope_filter", lambda s, d: read(s, d, "nation").select(F.lower("n_name").alias("name")).where(access.scope(F.col("name"), ["nation_1*", "nation_7", "*nothing"])), "SELECT lower(n_name) AS name FROM nation WHERE starts_with(lower(n_name), 'nation_1') OR lower(n_name) = 'nation_7'")


def _broken(s, d):
    c = collection(s, d)
    twice = c.where(_flag("quality", 0)).unionByName(c.where(_flag("toxic", 1)).withColumn("embedding", F.slice("embedding", 1, 10)))
    return integrity(c.unionByName(twice), 64)


_add("col_integrity_check", _broken, f"""WITH {_C}, x AS (SELECT seq, text, fv, 64 AS n FROM c UNION ALL SELECT seq, text, fv, 64 FROM c WHERE quality = 0 UNION ALL SELECT seq, text, fv, 10 FROM c WHERE toxic = 1)
SELECT 'duplicate_id' AS problem, count(*) AS n FROM (SELECT seq FROM x GROUP BY seq HAVING count(*) > 1)
UNION ALL SELECT 'wrong_dimension', count(*) FROM x WHERE fv IS NOT NULL AND n <> 64 UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'missing_field', count(*) FROM x WHERE text IS NULL OR fv IS NULL""")
_add("ops_metrics", lambda s, d: observe.metrics(read(s, d, "events").select(F.col("event_type").alias("op"), (F.col("user_id") % 3).cast("string").alias("collection"), "value"), "value"), """SELECT CAST(user_id % 3 AS VARCHAR) AS collection, event_type AS op, count(*) AS requests, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")


def _ivf(s, d):
    """As near as twelve of sixteen lists come; with all of them it is the exact search."""
    return rounded(ann.build_ivf(collection(s, d)).search(query_vector(s, d), 10, 12))


def _ivf_whole(s, d):
    return rounded(ann.build_ivf(collection(s, d)).search(query_vector(s, d), 10, 16))


def _queries(s, d) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    return read(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _recall(s, d):
    c = materialize(collection(s, d).where("embedding is not null").select("seq", "embedding"), "vectors")
    index, q = ann.build_ivf(c), _queries(s, d)
    true = materialize(search.batch_search(c, q, 10), "neighbours")  # compared six times
    return s.createDataFrame([(n, ann.recall(index.batch(q, 10, n), true)) for n in (1, 2, 4, 8, 12, 16)], "nprobe int, recall double")


def _ivf_batch(s, d):
    return rounded(ann.build_ivf(collection(s, d)).batch(_queries(s, d), 10, 16))


def _keyword_index(s, d):
    """Search of a stored index from which the documents of bad quality were removed again."""
    docs, bad = texts(s, d), read(s, d, "labels").where("quality = 0").select(F.col("doc_id").alias("seq"))
    index = bm25.KeywordIndex.build(docs)
    index.remove(bad)
    return rounded(index.search(WORDS, 10))


def _ndcg(s, d):
    """BM25's ranking of all documents for a query, judged by their quality label."""
    ranked = search.page(search.keyword_search(texts(s, d), WORDS, 50), 50).select(F.lit(1).alias("query_id"), "seq", "rank")
    judged = read(s, d, "labels").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("seq"), F.col("quality").cast("double").alias("gain"))
    return evaluate.ndcg(ranked, judged, 50).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def _through_store(s, d, then) -> DataFrame:
    """What a collection holds after ``then(db)`` on a table of all documents that have a vector."""
    db = VectorDB(s, new_path(s, "db"))
    db.create_collection("c", 64)
    db.insert_table("c", collection(s, d).where("text is not null and embedding is not null").select("id", "text", "embedding", "metadata"))
    then(db)
    return db.documents("c").select("id", "text", F.size("embedding").alias("dim"))


def _insert_batch(db):
    rows = [{"id": f"{i:032x}", "text": f"new {i}", "embedding": [float(i)] * 64} for i in range(5)]
    db.batch_insert("c", rows)
    db.insert("c", "new 5", [5.0] * 64, id=f"{5:032x}")
    db.update("c", f"{0:032x}", text="changed")
    db.delete("c", f"{1:032x}")


_STORED = f"WITH {_C} SELECT CAST(seq AS VARCHAR) AS id, text, 64 AS dim FROM c WHERE text IS NOT NULL AND fv IS NOT NULL"
_NEW = "SELECT '00000000-0000-0000-0000-00000000000' || i AS id, CASE WHEN i = 0 THEN 'changed' ELSE 'new ' || i END AS text, 64 AS dim FROM range(6) t(i) WHERE i <> 1"
_UUID = "00000000-0000-0000-0000-"


def _by_uuid(s, d) -> VectorDB:
    db = VectorDB(s, new_path(s, "db"))
    db.create_collection("c", 64)
    rows = collection(s, d).where("text is not null and embedding is not null")
    db.insert_table("c", rows.select(F.concat(F.lit(_UUID), F.lpad(F.col("seq").cast("string"), 12, "0")).alias("id"), "text", "embedding", "metadata"))
    for n in (3, 5, 8):
        db.delete("c", f"{_UUID}{n:012d}")
    return db


def _store_get(s, d):
    found = _by_uuid(s, d).get("c", f"{_UUID}{42:012d}")
    return s.createDataFrame([(found["id"], found["text"], found["metadata"]["lang"])], "id string, text string, lang string")


def _store_stats(s, d):
    stats = _by_uuid(s, d).stats("c")
    return s.createDataFrame([(stats.document_count, stats.deleted_count, stats.dimension, round(stats.deletion_ratio, 9))], "live bigint, deleted bigint, dimension int, ratio double")


def _store_search(s, d):
    found = _by_uuid(s, d).search("c", query_vector(s, d), k=10, filter=_EN)
    return s.createDataFrame([(r.id, round(r.score, 6)) for r in found], "id string, score double")


def _standby(s, d):
    """What a standby holds after it followed a log of all events, file by file."""
    log, target = new_path(s, "log"), new_path(s, "standby")
    _log(s, d).repartition(7, "id").write.parquet(log)
    replica.follow(s, log, target, new_path(s, "standby-checkpoint"), files_a_batch=2).awaitTermination()
    return replica.state(s, target).select("id", "seq", "text")


_STORE_C = f"{_C}, sc AS (SELECT *, '{_UUID}' || lpad(CAST(seq AS VARCHAR), 12, '0') AS id FROM c WHERE text IS NOT NULL AND fv IS NOT NULL)"
_add("store_get", _store_get, f"WITH {_STORE_C} SELECT id, text, lang FROM sc WHERE seq = 42")
_add("store_stats", _store_stats, f"WITH {_STORE_C} SELECT count(*) FILTER (seq NOT IN (3, 5, 8)) AS live, count(*) FILTER (seq IN (3, 5, 8)) AS deleted, 64 AS dimension, round(count(*) FILTER (seq IN (3, 5, 8)) / count(*)::DOUBLE, 9) AS ratio FROM sc")
_add("store_search", _store_search, f"""WITH {_STORE_C}, {_RESTORE} SELECT '{_UUID}' || lpad(CAST(seq AS VARCHAR), 12, '0') AS id, round(score, 6) AS score FROM (
SELECT seq, CASE WHEN sc = 0 THEN 0 ELSE list_cosine_similarity(rv, q) END AS score FROM r, q WHERE lang = 'en' AND text IS NOT NULL AND seq NOT IN (3, 5, 8) ORDER BY score DESC, seq DESC LIMIT 10)""")
_add("stream_standby", _standby, ORACLE_SQL["log_replay"])
_add("store_insert_table", lambda s, d: _through_store(s, d, lambda db: None), _STORED)
_add("store_insert_update_delete", lambda s, d: _through_store(s, d, _insert_batch), f"{_STORED} UNION ALL {_NEW}")
_add("store_save_rebuild", lambda s, d: _through_store(s, d, lambda db: (_insert_batch(db), db.save("c"), db.rebuild("c"), db.compact())), f"{_STORED} UNION ALL {_NEW}")
_add("store_backup_restore", lambda s, d: _through_store(s, d, lambda db: (_insert_batch(db), db.backup(f"{db.dir}-backup"), db.clear("c"), db.restore(f"{db.dir}-backup"))), f"{_STORED} UNION ALL {_NEW}")
_add("txt_stored_index_topk", _keyword_index, f"WITH c AS (SELECT doc_id AS seq, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), ct AS (SELECT * FROM c), {_bm_ctes(WORDS)} SELECT seq, round(score, 6) AS score FROM bm ORDER BY score DESC, seq DESC LIMIT 10")
_add("eval_ndcg", _ndcg, f"""WITH {_C}, {_bm_ctes(WORDS)}, r AS (SELECT seq, row_number() OVER (ORDER BY score DESC, seq DESC) AS n FROM bm),
j AS (SELECT quality, row_number() OVER (ORDER BY quality DESC, doc_id) AS n FROM labels)
SELECT 1 AS query_id, round(coalesce((SELECT sum(quality / log2(n + 1)) FROM r JOIN labels ON seq = doc_id WHERE n <= 50), 0) / (SELECT sum(quality / log2(n + 1)) FROM j WHERE n <= 50), 6) AS ndcg""")


def _pq(s, d):
    c = collection(s, d)
    pq = ann.Pq.train(c, 8)
    return rounded(pq.search(pq.encode(c), query_vector(s, d), 10))


_add("ann_ivf_topk", _ivf)
_add("ann_ivf_all_lists", _ivf_whole, _vec_sql())
_add("ann_ivf_batch", _ivf_batch, f"""WITH {_C} SELECT query_id, seq, round(score, 6) AS score FROM (
SELECT query_id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq DESC) AS n FROM (
SELECT vec_id AS query_id, seq, list_cosine_similarity(v, list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS score FROM cv, embeddings WHERE vec_id % 50 = 0)) WHERE n <= 10""")
_add("ann_recall", _recall)
# every row that its code error lets reach the k-th score is reranked, so the result is that of the exact search
_add("pq_adc_topk", _pq, _vec_sql())
