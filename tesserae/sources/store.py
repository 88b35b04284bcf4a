"""Collections on plain Parquet: an append-only log of mutations over immutable snapshot versions.

A collection is the last state of every id: its newest snapshot, then the log after it in order of ``seq``. Inserting an id
that exists replaces it. Saving or rebuilding writes a new version and removes the log below it.

The state of a collection is its newest state file. Each commit creates the next one, which fails if another writer was
faster, and what a commit writes is out of sight until then: a crash leaves the old state or the new one, whole.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import limits
from ..functions.distance import Metric
from ..functions.filters import compile_filter
from ..functions.schema import DOCUMENT, finite, tagged, untagged
from ..operators import ann, bm25, search
from .scratch import new_path, tidy_shuffles

LOG = "seq bigint, op string, id string, text string, embedding array<float>, metadata map<string,struct<b:boolean,i:bigint,f:double,s:string>>"


def replay(log: DataFrame) -> DataFrame:
    """The documents that a log leaves: the last operation on each id by ``seq``, unless it is a delete. Repeats do no harm."""
    last = log.groupBy("id").agg(F.max_by(F.struct(*log.columns), "seq").alias("r")).select("r.*")
    return last.where("op <> 'delete'").select("seq", "id", "text", "embedding", "metadata")


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``new``, which replace those of the same id."""
    return docs.join(new.select("id"), "id", "left_anti").select(*docs.columns).unionByName(new.select(*docs.columns))


def partial_update(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Fields of ``new(id, text, embedding, metadata)`` that are not null replace the old ones."""
    n = new.select("id", *[F.col(c).alias(f"__{c}") for c in ("text", "embedding", "metadata")])
    return docs.join(n, "id", "left").select("seq", "id", *[F.coalesce(f"__{c}", c).alias(c) for c in ("text", "embedding", "metadata")])


def deletion_ratio(docs: DataFrame) -> DataFrame:
    """(ratio) of rows marked ``deleted``; 0 for an empty table."""
    return docs.agg(F.coalesce(F.count_if("deleted") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("ratio"))


def memory_estimate(docs: DataFrame, raw: bool = False) -> DataFrame:
    """(bytes) that an in-memory index of the documents would need, without a graph.

    Terms are counted with the sizes in one pass, in which no text is shuffled by term; only where numbers repeat or are missing
    are the texts of those counted by number.
    """
    none = F.lit(0)
    dim = F.when(F.col("embedding").isNull(), none).otherwise(F.size("embedding"))
    each = dim * (5 if raw else 1) + 8 + 2 + 4 + F.coalesce(F.octet_length("text"), none) + 16 + F.size("metadata") * 64 + 64 + 24 + 16
    rows = docs.select("seq", "text", F.coalesce(each, none).alias("size"))
    again = docs.where("text is not null").groupBy("seq").agg(F.count("*").alias("n")).where("n > 1 or seq is null").select(F.col("seq").alias("of"))
    if not again.limit(1).count():
        terms = bm25.tally(rows)
    else:
        marked = rows.join(again.withColumn("again", F.lit(True)), F.col("seq").eqNullSafe(F.col("of")), "left")
        words = bm25.postings(marked.where("again")).groupBy("term").agg(F.count("*").alias("df"), F.lit(0).cast("bigint").alias("size"))
        terms = bm25.tally(marked.withColumn("text", F.when(F.col("again").isNull(), F.col("text")))).unionByName(words)
    terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))
    total = F.sum(F.when(F.col("term").isNull(), F.col("size")).otherwise(F.octet_length("term") + 24 + F.col("df") * 8 + 24))
    return terms.agg(F.coalesce(total, none).cast("bigint").alias("bytes"))


def integrity(docs: DataFrame, dimension: int) -> DataFrame:
    """(problem, n): repeated ids, wrong dimensions, vectors that are not finite, missing fields."""
    twice = docs.groupBy("id").count().where("count > 1")
    count = lambda name, rows: rows.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    out = count("duplicate_id", twice).unionByName(count("wrong_dimension", docs.where(F.size("embedding") != dimension)))
    return out.unionByName(count("not_finite", docs.where(~finite(F.col("embedding"))))).unionByName(count("missing_field", docs.where("id is null or text is null or embedding is null")))


class NotFound(KeyError):
    """There is no such collection or document."""

    code = 404


class BadRequest(ValueError):
    """An argument or document breaks a rule."""

    code = 400


class Conflict(ValueError):
    """The collection exists, or another writer committed first."""

    code = 409


class InsufficientStorage(RuntimeError):
    """The memory limit would be exceeded."""

    code = 507


class Corrupt(RuntimeError):
    """A snapshot is damaged, breaks the rules, or its key is missing or wrong."""

    code = 500


class ReadOnlyError(RuntimeError):
    """The database is a standby."""

    code = 503


@dataclass
class SearchResult:
    id: str
    text: str
    score: float
    metadata: dict


@dataclass
class CollectionInfo:
    name: str
    dimension: int
    document_count: int
    estimated_memory_bytes: int


@dataclass
class CollectionStats:
    """``deleted_count`` are the ids whose deletion is still in the log; a rebuild forgets them."""

    document_count: int
    deleted_count: int
    dimension: int
    deletion_ratio: float
    log_rows: int


@dataclass
class ReplayStats:
    """What a replay of the log met. ``damaged`` are rows without a known operation or id, which it skips."""

    inserted: int
    updated: int
    deleted: int
    damaged: int
    last_seq: int


def check_name(name: str) -> None:
    if not 1 <= len(name.encode()) <= limits.MAX_NAME_BYTES or not all(c.isalnum() or c in "_-" for c in name):
        raise BadRequest(f"bad collection name {name!r}")


def key_of(text: str) -> bytes:
    """A 32-byte key from 64 hexadecimal digits."""
    if not re.fullmatch(r"[0-9a-fA-F]{64}", text):
        raise BadRequest("a key has 64 hexadecimal digits")
    return bytes.fromhex(text)


def key_from_file(path: str) -> str:
    """The key in a local file of 64 hexadecimal digits, white space round them aside, or of 32 raw bytes."""
    with open(path, "rb") as f:
        raw = f.read()
    return raw.hex() if len(raw) == 32 else key_of(raw.decode("ascii", "replace").strip()).hex()


class VectorDB:
    """Collections under ``data_dir``, or in the session's shared scratch folder.

    With ``max_memory_bytes`` an insert that would bring the estimate of all collections beyond it is refused.
    """

    def __init__(self, spark: SparkSession, data_dir: str | None = None, encryption_key: str | None = None, read_only: bool = False, max_memory_bytes: int | None = None):
        self.spark, self.dir, self.persistent = spark, (data_dir or new_path(spark, "db")).rstrip("/"), data_dir is not None
        self.key, self.read_only, self.max_memory_bytes = encryption_key, read_only, max_memory_bytes
        if encryption_key:
            key_of(encryption_key)

    # files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _files(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _rename(self, old: str, new: str, replace: bool) -> None:
        """One atomic step; without ``replace`` it fails where ``new`` exists."""
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE" if replace else "NONE")
        target = self._fs(new)[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs(old)[1], target, options)

    def _put(self, path: str, value: dict, replace: bool = True) -> None:
        """Write a small file whole: aside first, then renamed."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        aside = f"{path}.{uuid.uuid4().hex}"
        out = fs.create(self._fs(aside)[1], True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            self._rename(aside, path, replace)
        except Exception as e:
            self._delete(aside)
            if not replace and self._exists(path):
                raise Conflict(f"another writer committed {path} first") from e
            raise

    def _get(self, path: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(path).collect()))

    def _state(self, name: str) -> dict:
        """The newest state: the configuration, the snapshot version, and the bounds of the log after it."""
        files = [f for f in self._files(f"{self.dir}/{name}/state") if re.fullmatch(r"\d{12}\.json", f)]
        if not files:
            raise NotFound(name)
        return self._get(f"{self.dir}/{name}/state/{files[-1]}") | {"nth": int(files[-1][:12])}

    def _commit(self, name: str, state: dict, **changes) -> None:
        """Make ``state`` with ``changes`` the next state; Conflict if it isn't the newest any more."""
        new = {k: v for k, v in (state | changes).items() if k != "nth"}
        self._put(f"{self.dir}/{name}/state/{state['nth'] + 1:012d}.json", new, replace=False)
        for f in self._files(f"{self.dir}/{name}/state"):
            if re.fullmatch(r"\d{12}\.json", f) and int(f[:12]) < state["nth"]:
                self._delete(f"{self.dir}/{name}/state/{f}")

    def _config(self, name: str) -> dict:
        return self._state(name)["config"]

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError("a standby takes no changes until it is promoted")

    def promote(self) -> None:
        self.read_only = False

    # collections

    def create_collection(self, name: str, dimension: int, m: int | None = None, ef_construction: int | None = None, ef_search: int | None = None, distance_metric: str | None = None, store_raw_vectors: bool | None = None) -> None:
        """``ef_search`` is how many vectors an approximate search compares at least; ``m`` and ``ef_construction`` are checked and
        kept but have no meaning for lists."""
        self._writable()
        check_name(name)
        if not 1 <= dimension <= limits.MAX_DIMENSION:
            raise BadRequest("dimension out of range")
        for v, (low, high) in ((m, limits.M_RANGE), (ef_construction, limits.EF_RANGE), (ef_search, limits.EF_RANGE)):
            if v is not None and not low <= v <= high:
                raise BadRequest("index parameter out of range")
        metric = Metric.of(distance_metric).value
        if self._exists(f"{self.dir}/{name}/state"):
            raise Conflict(f"collection {name!r} exists")
        self._create(name, {"dimension": dimension, "metric": metric, "raw": bool(store_raw_vectors), "m": m or limits.M, "ef_construction": ef_construction or limits.EF_CONSTRUCTION, "ef_search": ef_search or limits.EF_SEARCH})

    def _create(self, name: str, config: dict) -> None:
        self._put(f"{self.dir}/{name}/state/{0:012d}.json", {"config": config, "version": None, "from": 0, "next": 1}, replace=False)

    def delete_collection(self, name: str) -> bool:
        self._writable()
        there = self._exists(f"{self.dir}/{name}/state")
        if there:
            self._delete(f"{self.dir}/{name}")
        return there

    def list_collections(self, patterns: list[str] | None = None) -> list[str]:
        from ..plans.access import matches

        return [n for n in self._files(self.dir) if self._exists(f"{self.dir}/{n}/state") and matches(patterns, n)]

    def clear(self, name: str) -> None:
        """No documents, the same configuration: one commit, which also ends the log."""
        self._writable()
        state = self._state(name)
        self._commit(name, state, version=None, index=None, **{"from": state["next"]})
        self._prune(name)

    def collection_info(self, name: str) -> CollectionInfo:
        config, docs = self._config(name), self.documents(name)
        return CollectionInfo(name, config["dimension"], docs.count(), memory_estimate(docs, config["raw"]).first().bytes)

    def total_memory_bytes(self) -> int:
        return sum(self.collection_info(n).estimated_memory_bytes for n in self.list_collections())

    def stats(self, name: str) -> CollectionStats:
        state, log = self._state(name), self.log(name)
        gone = log.groupBy("id").agg(F.max_by("op", "seq").alias("op")).where("op = 'delete'").count()
        live = self.documents(name).count()
        return CollectionStats(live, gone, state["config"]["dimension"], gone / (live + gone) if live + gone else 0.0, log.count())

    def deleted_count(self, name: str) -> int:
        return self.stats(name).deleted_count

    def replay_stats(self, name: str) -> ReplayStats:
        """What a replay of the present log meets."""
        op = F.col("op")
        good = op.isin("insert", "update", "delete") & F.col("id").isNotNull()
        n = lambda x: F.coalesce(F.count_if(good & (op == x)), F.lit(0))
        row = self._raw_log(name).agg(n("insert"), n("update"), n("delete"), F.count_if(~F.coalesce(good, F.lit(False))), F.coalesce(F.max("seq"), F.lit(0))).first()
        return ReplayStats(*row)

    def _raw_log(self, name: str) -> DataFrame:
        state, path = self._state(name), f"{self.dir}/{name}/log"
        rows = self.spark.read.schema(LOG).parquet(path) if self._files(path) else self.spark.createDataFrame([], LOG)
        return rows.where((F.col("seq") >= state["from"]) & (F.col("seq") < state["next"]))

    def log(self, name: str) -> DataFrame:
        """The mutations after the current snapshot; damaged rows are left out."""
        return self._raw_log(name).where(F.col("op").isin("insert", "update", "delete") & F.col("id").isNotNull())

    def documents(self, name: str, id: str | None = None) -> DataFrame:
        """The live documents, lazily; of one ``id`` alone where it is given, so that only its rows are read and folded."""
        state = self._state(name)
        base = self.spark.createDataFrame([], DOCUMENT) if state["version"] is None else self._read(state["version"], self.key)
        rows = base.withColumn("op", F.lit("insert")).unionByName(self.log(name))
        return replay(rows if id is None else rows.where(F.col("id") == id))

    # documents

    def _append(self, name: str, rows: list[tuple]) -> None:
        """``rows`` (op, id, text, embedding, metadata) get consecutive numbers; one commit."""
        state = self._state(name)
        data = [(state["next"] + i, *r) for i, r in enumerate(rows)]
        self._publish(name, state, self.spark.createDataFrame(data, LOG).coalesce(1), state["next"] + len(rows))

    def _publish(self, name: str, state: dict, rows: DataFrame, end: int | None = None, check=None) -> None:
        """Write log rows aside, commit the numbers that they take unless ``check`` of them raises, then move them into the log."""
        aside = f"{self.dir}/{name}/aside-{uuid.uuid4().hex}"
        try:
            with tidy_shuffles(self.spark):
                rows.write.parquet(aside)
            written = self.spark.read.schema(LOG).parquet(aside)
            if check is not None:
                check(written)
            if end is None:
                end = (written.agg(F.max("seq")).first()[0] or state["next"] - 1) + 1
            fs, p = self._fs(f"{self.dir}/{name}/log")
            fs.mkdirs(p)
            self._commit(name, state, next=end)
            for k, f in enumerate(x for x in self._files(aside) if x.endswith(".parquet")):
                # the name tells the last number, by which a file is known to lie below a snapshot
                self._rename(f"{aside}/{f}", f"{self.dir}/{name}/log/{end - 1:020d}-{k:05d}-{uuid.uuid4().hex}.parquet", False)
        finally:
            self._delete(aside)

    def _prune(self, name: str) -> None:
        """Remove the files of the log that lie below the snapshot, and snapshots that no state names."""
        state = self._state(name)
        for f in self._files(f"{self.dir}/{name}/log"):
            if re.match(r"\d{20}-", f) and int(f[:20]) < state["from"]:
                self._delete(f"{self.dir}/{name}/log/{f}")
        for f in self._files(f"{self.dir}/{name}"):
            if f.startswith(("version-", "index-")) and f"{self.dir}/{name}/{f}" not in (state["version"], (state.get("index") or {}).get("path")):
                self._delete(f"{self.dir}/{name}/{f}")

    def _reserve(self, size: int) -> None:
        if self.max_memory_bytes is not None:
            used = self.total_memory_bytes()
            if used + size > self.max_memory_bytes:
                raise InsufficientStorage(f"{used} bytes are used and {size} more are asked for, of {self.max_memory_bytes}")

    def _row(self, config: dict, document: dict, where: str = "") -> tuple:
        if "text" not in document or "embedding" not in document:
            raise BadRequest(f"text and embedding are needed{where}")
        text, vector, meta = document["text"], [float(x) for x in document["embedding"]], document.get("metadata") or {}
        if len(vector) != config["dimension"]:
            raise BadRequest(f"the embedding has {len(vector)} components, not {config['dimension']}{where}")
        if not all(map(math.isfinite, vector)):
            raise BadRequest(f"the embedding is not finite{where}")
        if len(text.encode()) > limits.MAX_TEXT_BYTES or len(meta) > limits.MAX_METADATA_KEYS or len(json.dumps(meta).encode()) > limits.MAX_METADATA_BYTES:
            raise BadRequest(f"text or metadata too large{where}")
        known = document.get("id")
        return ("insert", str(uuid.UUID(known)) if known else str(uuid.uuid4()), text, vector, {k: tagged(v) for k, v in meta.items()})

    def insert(self, collection: str, text: str, embedding: list[float], metadata: dict | None = None, id: str | None = None) -> str:
        return self.batch_insert(collection, [{"text": text, "embedding": embedding, "metadata": metadata, "id": id}])[0]

    def batch_insert(self, collection: str, documents: list[dict]) -> list[str]:
        """All rows are checked before any is written; ids in order."""
        config = self._config(collection)
        self._writable()
        if len(documents) > limits.MAX_BATCH:
            raise BadRequest(f"at most {limits.MAX_BATCH} documents at once; use insert_table for more")
        rows = [self._row(config, d, f" (document {i})") for i, d in enumerate(documents)]
        if rows:
            self._reserve(sum(4 * len(r[3]) + len(r[2].encode()) + 256 for r in rows))
            self._append(collection, rows)
        return [r[1] for r in rows]

    def insert_table(self, collection: str, docs: DataFrame) -> None:
        """Insert ``docs(id, text, embedding, metadata)`` of any size as one commit, numbered by the order of ids."""
        state = self._state(collection)
        self._writable()
        meta = F.coalesce(F.octet_length(F.to_json("metadata")), F.lit(0))
        good = (
            F.col("id").isNotNull() & (F.octet_length("text") <= limits.MAX_TEXT_BYTES) & (F.size("embedding") == state["config"]["dimension"]) & finite(F.col("embedding"))
            & (F.coalesce(F.size("metadata"), F.lit(0)) <= limits.MAX_METADATA_KEYS) & (meta <= limits.MAX_METADATA_BYTES)
        )
        size = F.size("embedding") * 4 + F.octet_length("text") + 256

        def check(written: DataFrame) -> None:
            bad, most = written.agg(F.count_if(~F.coalesce(good, F.lit(False))), F.sum(size)).first()
            if bad:
                raise BadRequest("a row has no id, text or embedding, a wrong dimension, a value that is not finite, or is too large")
            if self.max_memory_bytes is not None:
                self._reserve(most or 0)

        # sorted partitions follow each other, and so do their numbers, with gaps
        ordered = docs.orderBy("id").select((F.monotonically_increasing_id() + state["next"]).alias("seq"), F.lit("insert").alias("op"), "id", "text", "embedding", "metadata")
        # rows are checked as they lie aside, so that docs are computed once
        self._publish(collection, state, ordered, check=check)

    def get(self, collection: str, id: str) -> dict:
        row = self.documents(collection, str(uuid.UUID(id))).first()
        if row is None:
            raise NotFound(id)
        return {"id": row.id, "text": row.text, "metadata": {k: untagged(v) for k, v in (row.metadata or {}).items()}}

    def delete(self, collection: str, id: str) -> bool:
        self._writable()
        if not self.documents(collection, str(uuid.UUID(id))).count():
            return False
        self._append(collection, [("delete", str(uuid.UUID(id)), None, None, None)])
        return True

    def update(self, collection: str, id: str, text: str | None = None, embedding: list[float] | None = None, metadata: dict | None = None) -> None:
        """Fields that are None keep their value."""
        config = self._config(collection)
        self._writable()
        row = self.documents(collection, str(uuid.UUID(id))).first()
        if row is None:
            raise NotFound(id)
        old = {k: untagged(v) for k, v in (row.metadata or {}).items()}
        new = {"id": id, "text": row.text if text is None else text, "embedding": row.embedding if embedding is None else embedding, "metadata": old if metadata is None else metadata}
        self._append(collection, [("update", *self._row(config, new)[1:])])

    def build_index(self, collection: str, lists: int | None = None) -> int:
        """Store inverted lists (about the root of the number of documents, unless told) for approximate search; their number."""
        self._writable()
        state = self._state(collection)
        docs = self.documents(collection)
        lists = lists or max(1, int(docs.count() ** 0.5))
        path = f"{self.dir}/{collection}/index-{uuid.uuid4().hex}"
        ann.build_ivf(docs, lists, state["config"]["metric"], path=path)
        self._commit(collection, state, index={"path": path, "next": state["next"], "lists": lists})
        self._prune(collection)
        return lists

    def _candidates(self, docs: DataFrame, state: dict, query: list[float], n: int, where: dict | None) -> DataFrame:
        """Documents in the lists nearest to ``query``, ``ef_search`` of them at least, and all that are newer than the index.

        While fewer than ``n`` pass the filter, twice as many are taken, up to four times ``ef_search``, then all.
        """
        index, fresh = ann.Ivf.open(self.spark, state["index"]["path"]), F.col("seq") >= state["index"]["next"]
        ef = max(state["config"]["ef_search"], n)
        for factor in (1, 2, 4):
            near = index.probe(query, n, ef_search=ef * factor).select("seq")
            found = docs.where(~fresh).join(near, "seq", "left_semi").unionByName(docs.where(fresh))
            if found.where(compile_filter(where)).limit(n).count() >= n:
                return found
        return docs

    def search(self, collection: str, query_embedding: list[float] | None = None, query_text: str | None = None, k: int = limits.DEFAULT_K, min_similarity: float | None = None, alpha: float = limits.DEFAULT_ALPHA, fusion_method: str = limits.DEFAULT_FUSION, filter: dict | None = None, offset: int = 0, approximate: bool = False) -> list[SearchResult]:
        """Exact unless ``approximate``, for which the index must have been built; keywords are always exact."""
        state = self._state(collection)
        config = state["config"]
        if not 0 <= k <= limits.MAX_K or not 0 <= offset <= limits.MAX_OFFSET:
            raise BadRequest("k or offset out of range")
        if query_embedding is not None and (len(query_embedding) != config["dimension"] or not all(map(math.isfinite, query_embedding))):
            raise BadRequest("bad query embedding")
        docs = self.documents(collection)
        among = docs
        if approximate:
            if query_embedding is None or query_text is not None:
                raise BadRequest("approximate search is for vectors alone")
            if not state.get("index"):
                raise BadRequest("the collection has no index; build_index makes one")
            among = self._candidates(docs, state, query_embedding, k + offset, filter)
        rows = search.search(among, query_embedding, query_text, k, offset, alpha, fusion_method, min_similarity, filter, config["metric"], "exact" if config["raw"] else "compact")
        found = search.with_documents(rows, docs).orderBy("rank").collect()
        return [SearchResult(r.id, r.text, r.score, {k: untagged(v) for k, v in (r.metadata or {}).items()}) for r in found]

    # snapshots

    def _write(self, docs: DataFrame, path: str, key: str | None) -> None:
        body = docs.select(F.to_json(F.struct("seq", "id", "text", "embedding", "metadata")).alias("body"))
        if key:
            out = body.select(F.aes_encrypt("body", F.lit(key_of(key)), F.lit("GCM")).alias("data"), F.lit(None).cast("bigint").alias("crc"))
        else:
            out = body.select(F.col("body").cast("binary").alias("data"), F.crc32(F.col("body").cast("binary")).alias("crc"))
        out.write.parquet(path)

    def _read(self, path: str, key: str | None) -> DataFrame:
        """Documents of a snapshot; RuntimeError where a row fails its checksum or doesn't decrypt."""
        if not self._exists(path):
            raise Corrupt(f"no snapshot at {path}")
        raw = self.spark.read.parquet(path)
        plain = F.when(F.col("crc").isNotNull(), F.when(F.crc32("data") == F.col("crc"), F.col("data")))
        if key:
            plain = F.coalesce(plain, F.try_aes_decrypt("data", F.lit(key_of(key)), F.lit("GCM")))
        rows = raw.select(plain.cast("string").alias("body"))
        if rows.where("body is null").limit(1).count():
            raise Corrupt(f"the snapshot at {path} is corrupt, or the key is missing or wrong")
        return rows.select(F.from_json("body", DOCUMENT).alias("r")).select("r.*")

    def save(self, collection: str, path: str | None = None, encryption_key: str | None = None) -> None:
        """Write a snapshot: to ``path``/<collection>, or as the new version of the collection, which ends its log.

        A snapshot at ``path`` is replaced by one step, after the new one is whole.
        """
        key = encryption_key or self.key
        if not path:
            if not self.persistent:
                raise BadRequest("no path and no data_dir")
            self._snapshot(collection)
            return
        target, data = f"{path.rstrip('/')}/{collection}", f"data-{uuid.uuid4().hex}"
        self._write(self.documents(collection), f"{target}/{data}", key)
        self._put(f"{target}/snapshot.json", {"config": self._config(collection), "data": data})
        for f in self._files(target):
            if f.startswith("data-") and f != data:
                self._delete(f"{target}/{f}")

    def _snapshot(self, name: str, docs: DataFrame | None = None, **changes) -> None:
        state = self._state(name)
        version = f"{self.dir}/{name}/version-{uuid.uuid4().hex}"
        self._write(self.documents(name) if docs is None else docs, version, self.key)
        # readers see the old version and its log, or the new one and an empty log; a change made meanwhile is a Conflict
        self._commit(name, state, **({"version": version, "from": state["next"]} | changes))
        self._prune(name)

    def load(self, name: str, path: str | None = None, encryption_key: str | None = None) -> None:
        """Replace a collection by a saved snapshot, in one step, once that is known to be whole."""
        if not path and not self.persistent:
            raise BadRequest("no path and no data_dir")
        self._writable()
        if not path:
            self._state(name)
            return
        source = f"{path.rstrip('/')}/{name}"
        if not self._exists(f"{source}/snapshot.json"):
            raise Corrupt(f"no snapshot at {source}")
        saved = self._get(f"{source}/snapshot.json")
        docs, config = self._read(f"{source}/{saved['data']}", encryption_key or self.key), saved["config"]
        if integrity(docs, config["dimension"]).agg(F.sum("n")).first()[0]:
            raise Corrupt(f"the snapshot of {name!r} breaks the rules of a collection")
        if not self._exists(f"{self.dir}/{name}/state"):
            self._create(name, config)
        end = max(self._state(name)["next"], (docs.agg(F.max("seq")).first()[0] or 0) + 1)
        self._snapshot(name, docs, config=config, index=None, **{"from": end, "next": end})

    def load_all(self, path: str) -> list[str]:
        """Load every snapshot under ``path``; the first bad one raises. Their names."""
        names = [n for n in self._files(path) if self._exists(f"{path.rstrip('/')}/{n}/snapshot.json")]
        for n in names:
            self.load(n, path)
        return names

    def rebuild(self, collection: str) -> int:
        """Fold the log into a new version, and make the index anew if there is one; the number of live documents."""
        self._writable()
        self._snapshot(collection)
        index = self._state(collection).get("index")
        if index:
            self.build_index(collection, index["lists"])
        return self.documents(collection).count()

    def compact(self) -> list[str]:
        """Fold the log of every collection into a new version and remove it; their names."""
        self._writable()
        names = self.list_collections()
        for name in names:
            self._snapshot(name)
        return names

    def auto_compact(self, ratio: float = limits.AUTO_COMPACT_RATIO) -> list[str]:
        """Rebuild the collections whose updates and deletes outweigh ``ratio`` of their documents; their names."""
        out = []
        for name in self.list_collections():
            changed = self.log(name).where("op <> 'insert'").count()
            if changed > ratio * max(1, self.documents(name).count()):
                self.rebuild(name)
                out.append(name)
        return out

    def backup(self, path: str) -> None:
        """Snapshots of all collections; their logs stay."""
        for name in self.list_collections():
            self.save(name, path)

    def restore(self, path: str) -> None:
        """Load every snapshot of a backup; the first bad one raises."""
        self.load_all(path)

    def __enter__(self) -> "VectorDB":
        return self

    def __exit__(self, *_) -> None:
        if self.persistent and not self.read_only:
            for name in self.list_collections():
                self.save(name)
