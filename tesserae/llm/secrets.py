"""Incremental secret scans over a ledger of content-addressed blobs.

A blob is the SHA-256 of a text. The ledger has three tables: which (rule, version) pairs each blob was scanned for, the
findings of a blob, and every path that ever held it. A scan looks only at pairs that are not in the ledger, and findings reach
all paths, those that hold another text by now too, by a join on the blob.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path, tidy_shuffles


@dataclass(frozen=True)
class Rule:
    """A pattern, and literals of which every match contains one (checked before the pattern is tried).

    ``folded``: the literals are sought in the text in lower case.
    """

    name: str
    version: int
    pattern: str
    literals: tuple[str, ...]
    folded: bool = False


RULES = (
    Rule("aws_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"gh[pousr]_[A-Za-z0-9]{30,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("slack_token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    Rule("stripe_key", 1, r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", ("k_live_", "k_test_")),
    Rule("private_key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", ("PRIVATE KEY-----",)),
    Rule("json_web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    Rule("assigned_secret", 2, r"(?i)(?:api_key|apikey|secret|token|password|passwd)[\"']?\s*[=:][ \t]*[\"']?[A-Za-z0-9_/+=-]{12,}", ("api_key", "apikey", "secret", "token", "passw"), True),
)
_FIRST = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned_secret": r"(?:api_key|apikey|secret|token|password|passwd)[ ]*[=:][ ]*[\"']?[A-Za-z0-9_/+=-]{12,}",
}
#: The rules as they were before the two were widened.
FIRST_RULES = tuple(replace(r, version=1, pattern=_FIRST[r.name], folded=False) if r.name in _FIRST else r for r in RULES)
SCANNED = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, nth int, secret string"


def mentions(rule: Rule, text: Column) -> Column:
    text = F.lower(text) if rule.folded else text
    return reduce(lambda a, b: a | b, [text.contains(x) for x in rule.literals])


def _load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _key_type(docs: DataFrame) -> str:
    return "bigint" if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the unseen (blob, rule version) pairs of ``docs``; append them, their findings and the paths to the ledger.

    A row is scanned once for each blob, and only for the pairs that the ledger lacks. Findings are written first: a run that
    dies in between is repeated whole, and readers drop repeated findings. Null texts are no blobs; an empty text is one.
    Ids of any kind are taken; those that are no integers become strings. No text leaves its task unless it mentions a
    literal of a rule.
    """
    spark = docs.sparkSession
    pair = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))
    every = F.array(*[pair(r) for r in rules])
    seen = _load(spark, f"{ledger}/scanned", SCANNED).groupBy("blob").agg(F.collect_list(F.struct("rule", "version")).alias("seen"))
    none = F.array().cast("array<struct<rule:string,version:int>>")
    texts = docs.where("text is not null").select(F.col("doc_id").cast(_key_type(docs)).alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    unseen = texts.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("seen", none)).alias("pairs")).where("size(pairs) > 0")
    hits = texts.withColumn("which", F.array_compact(F.array(*[F.when(mentions(r, F.col("text")), pair(r)) for r in rules])))
    hits = hits.where("size(which) > 0").groupBy("blob").agg(F.min("text").alias("text"), F.first("which").alias("which"))
    hits = hits.join(seen, "blob", "left").select("blob", "text", F.explode(F.array_except("which", F.coalesce("seen", none))).alias("pair")).select("blob", "text", "pair.*")
    match = reduce(lambda c, r: c.when(F.col("rule") == r.name, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))), rules, F.when(F.lit(False), F.array().cast("array<string>")))
    found = hits.select("blob", "rule", "version", F.posexplode(match).alias("nth", "secret"))
    with tidy_shuffles(spark):
        found.write.mode("append").parquet(f"{ledger}/findings")
        texts.select("doc_id", "blob").write.mode("append").parquet(f"{ledger}/paths")
        unseen.select("blob", F.explode("pairs").alias("p")).select("blob", "p.*").write.mode("append").parquet(f"{ledger}/scanned")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rule, nth, secret_sha256, hint) of every path: each distinct (doc_id, text) and finding gives one row.

    Of a rule that a blob was scanned for in several versions the newest counts, and only rules of ``rules`` do. A null doc_id
    keeps its findings. ``nth`` counts the matches of a rule in a text from 0; only a hash and the first four characters of a
    secret are shown. An empty ledger has no rows.
    """
    found = _load(spark, f"{ledger}/findings", FINDINGS).where(F.col("rule").isin([r.name for r in rules])).distinct()
    scanned = _load(spark, f"{ledger}/scanned", SCANNED).join(found.select("blob").distinct(), "blob", "left_semi")
    newest = scanned.groupBy("blob", "rule").agg(F.max("version").alias("version"))
    paths = spark.read.parquet(f"{ledger}/paths").distinct()
    return paths.join(found.join(newest, ["blob", "rule", "version"]), "blob").select("doc_id", "rule", "nth", F.sha2("secret", 256).alias("secret_sha256"), F.left("secret", F.lit(4)).alias("hint"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``update`` then ``findings`` of all that the ledger knows; without a ledger a new one is made in the shared folder."""
    ledger = ledger or new_path(docs.sparkSession, "blob-ledger")
    update(docs, ledger, rules)
    return findings(docs.sparkSession, ledger, rules)


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows and columns of ``docs`` with each found secret replaced by ``[rule]``; ``n_chars`` follows where present.

    Rows with a null text or id, repeated rows and empty tables pass as they are. Only the few rows that mention a literal
    meet the findings; all others pass by without a shuffle.
    """
    ledger = ledger or new_path(docs.sparkSession, "blob-ledger")
    update(docs, ledger, rules)
    found = _load(docs.sparkSession, f"{ledger}/findings", FINDINGS).groupBy(F.col("blob").alias("__blob")).agg(F.collect_set("rule").alias("__rules"))
    maybe = F.coalesce(reduce(lambda a, b: a | b, [mentions(r, F.col("text")) for r in rules]), F.lit(False))
    rows = docs.where(maybe).withColumn("__key", F.unhex(F.sha2("text", 256))).join(found, F.col("__key") == F.col("__blob"), "left")
    pattern = lambda r: F.when(F.array_contains("__rules", r.name), F.lit(r.pattern)).otherwise(F.lit("(?!)"))
    text = reduce(lambda c, r: F.regexp_replace(c, pattern(r), F.lit(f"[{r.name}]")), rules, F.col("text"))
    rows = rows.withColumn("text", text).drop("__key", "__blob", "__rules")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~maybe).unionByName(rows)


SCAN_SQL = "\nUNION ALL\n".join(
    f"""SELECT doc_id, '{r.name}' AS rule, CAST(n - 1 AS INTEGER) AS nth, sha256(s[n]) AS secret_sha256, left(s[n], 4) AS hint FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (
    SELECT doc_id, regexp_extract_all(text, '{r.pattern.replace("'", "''")}') AS s FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL))"""
    for r in RULES
)
