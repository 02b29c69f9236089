"""Lexical and vector search over messages, and their fusion."""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists
from sessionlake.functions.hashing import project_scope_token
from sessionlake.functions.text import query_terms, terms
from sessionlake.functions.vectors import dot, norm, query_vector
from sessionlake.operators.store import Store, searchable
from sessionlake.runtime import Folder, table

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF_K = 60
LEAST_CANDIDATES = 50


def scope_tokens(project: Column, role: Column, provider: Column) -> Column:
    """The three tokens that stand for a message's project, role and provider in its indexed text."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.array(project_scope_token(project), F.concat(F.lit("r"), plain(role)), F.concat(F.lit("v"), plain(provider)))


def provider_of(session: Column) -> Column:
    """The provider in front of a session id."""
    return F.substring_index(session, ":", 1)


def documents(store: Store) -> DataFrame:
    """``key, session_id, seq, role, project_key, provider, terms``: the searchable messages with their indexed terms.

    The key of a message without event id is session, seq and role.
    """
    messages = store.rows("messages", "seq", "role", "text", "project_key", where=searchable())
    named = messages.withColumn("provider", provider_of(F.col("session_id")))
    key = F.coalesce("event_id", F.concat_ws(":", "session_id", F.col("seq").cast("string"), "role"))
    tokens = F.concat(F.coalesce(scope_tokens(F.col("project_key"), F.col("role"), F.col("provider")), F.array().cast("array<string>")), F.coalesce(terms(F.col("text")), F.array().cast("array<string>")))
    return named.select(key.alias("key"), "session_id", "seq", "role", "project_key", "provider", tokens.alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """``term, key, tf, length``: the inverted index, for storing partitioned by term."""
    exploded = docs.select("key", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return exploded.groupBy("term", "key", "length").agg(F.count("*").alias("tf"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("terms", lambda x: x == F.lit(term)))


def lexical_search(docs: DataFrame, text: str, limit: int = 20, offset: int = 0, where: Column | None = None, scoped: dict[str, str] | None = None) -> DataFrame:
    """``key, session_id, seq, rank, score``: messages with every term of ``text``, ranked by BM25, ties by key.

    The score is one over the rank. ``scoped`` names scope tokens that take part in the match and the
    ranking; ``where`` only filters. A query without terms has no results. This reads all of ``docs``, twice,
    and is for tables without a stored index.
    """
    wanted = list(dict.fromkeys([*query_terms(text), *(scoped or {}).values()]))
    frequency = {t: _occurrences(t) for t in wanted}
    if not query_terms(text):
        return docs.limit(0).select("key", "session_id", "seq", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score"))
    narrow = docs.select("key", "session_id", "seq", "role", "project_key", "provider", F.size("terms").alias("_length"), *[f.alias(f"_tf{i}") for i, f in enumerate(frequency.values())])
    stats = narrow.agg(F.count("*").alias("n"), F.avg("_length").alias("mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))]).first()
    total, mean = stats["n"], stats["mean"] or 1.0
    score: Column = F.lit(0.0)
    matched = narrow if where is None else narrow.where(where)
    for i in range(len(wanted)):
        held = stats[f"df{i}"] or 0
        idf = max(LEAST_IDF, math.log((total - held + 0.5) / (held + 0.5))) if total else LEAST_IDF
        tf = F.col(f"_tf{i}")
        matched = matched.where(tf > 0)
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.lit(mean)))
    page = matched.withColumn("_bm25", F.round(score, 9)).orderBy(F.desc("_bm25"), "key").limit(offset + limit)
    # one page of rows: numbering it in one task is what a ranked page is
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_bm25"), "key")).cast("long")).where(F.col("rank") > offset)
    return ranked.select("key", "session_id", "seq", "rank", (F.lit(1.0) / F.col("rank")).alias("score"))


def counted_terms(docs: DataFrame, about: list[str]) -> DataFrame:
    """``about, length, term, tf``: the different terms of each message, the empty one included; counted where the message is, without a shuffle."""

    def make():
        def count(rows: dict) -> dict:
            out: dict[str, list] = {c: [] for c in (*about, "length", "term", "tf")}
            for i, terms in enumerate(rows["terms"]):
                counts = Counter(terms or ())
                counts[""] = 1
                for c in about:
                    out[c] += [rows[c][i]] * len(counts)
                out["length"] += [len(terms or ())] * len(counts)
                out["term"] += counts.keys()
                out["tf"] += counts.values()
            return out

        return count

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in about)
    return map_lists(docs.select(*about, "terms"), make, f"{fields}, length int, term string, tf int")


class LexicalIndex:
    """The inverted index as stored: postings in buckets of a hash of the term, sorted by term, and what the ranking needs to know of all messages.

    Re-deliveries and roles that search does not see are gone when it is built. A search reads the buckets of
    its few terms, of which the sorted files let it skip what other terms have. Beside the postings each message
    has a row of its length under the empty term.
    """

    BUCKETS = 64
    #: Part of the folder's name, to be raised with every change of what is stored.
    FORMAT = 4

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.files = Folder(spark, folder)

    @classmethod
    def of(cls, store: Store, shared: str) -> LexicalIndex:
        """The index of the store's messages in their present state, below the ``shared`` folder."""
        state = hashlib.sha256(f"{cls.FORMAT}\n{cls.BUCKETS}\n{store.base}\n{Folder(store.spark, store.base).stamp('messages.parquet')}".encode()).hexdigest()[:16]
        index = cls(store.spark, f"{shared}/lexical-{state}")
        if not index.files.has("stats.json"):
            index.build(documents(store))
        return index

    def build(self, docs: DataFrame) -> None:
        """Write the postings of ``docs`` and then the statistics, whose file says that the index is whole."""
        found = counted_terms(docs, ["key", "session_id", "seq", "role", "project_key", "provider"])
        bucket = (F.crc32(F.encode("term", "UTF-8")) % self.BUCKETS).cast("int")
        # the empty term is that of all messages, so its rows are dealt out; a frequent term's are cut by the size of its files
        spread = F.when(F.col("term") == "", F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int")).otherwise(bucket)
        rows = found.withColumn("_bucket", spread).withColumn("is_length", F.col("term") == "")
        tasks = max(self.BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # a number of its own, which adaptive execution leaves as it is
        rows.repartition(tasks, "_bucket", F.pmod(F.xxhash64("key"), F.lit(2))).sortWithinPartitions("_bucket", "term").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/postings")
        total = self.postings().where("is_length").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        self.files.write("stats.json", json.dumps({"n": total["n"], "mean": total["mean"]}))

    def _bucket_of(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8")) % self.BUCKETS

    def postings(self, buckets: set[int] | None = None) -> DataFrame:
        """``term, key, session_id, seq, role, project_key, provider, length, tf, is_length``, of all buckets or only some."""
        schema = "term string, key string, session_id string, seq bigint, role string, project_key string, provider string, length int, tf int, is_length boolean"
        reader = self.spark.read.schema(schema)
        if buckets is None:
            return reader.parquet(f"{self.folder}/postings")
        held = [f"postings/_bucket={b}" for b in sorted(buckets) if self.files.has(f"postings/_bucket={b}")]
        return reader.parquet(*[f"{self.folder}/{h}" for h in held]) if held else self.spark.createDataFrame([], schema)

    def search(self, text: str, limit: int = 20, offset: int = 0, where: Column | None = None, scoped: dict[str, str] | None = None) -> DataFrame:
        """What ``lexical_search`` gives, from the postings of the terms."""
        wanted = list(dict.fromkeys([*query_terms(text), *(scoped or {}).values()]))
        if not query_terms(text):
            return self.postings().limit(0).select("key", "session_id", "seq", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score"))
        rows = self.postings({self._bucket_of(t) for t in wanted}).where(F.col("term").isin(*wanted))
        stats = json.loads(self.files.read("stats.json"))
        held = {r["term"]: r["count"] for r in rows.groupBy("term").count().collect()}
        total, mean = stats["n"], stats["mean"] or 1.0
        about = ["key", "session_id", "seq", "length"]
        matched = (rows if where is None else rows.where(where)).groupBy(*about).agg(*[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"_tf{i}") for i, t in enumerate(wanted)])
        score: Column = F.lit(0.0)
        for i, t in enumerate(wanted):
            df = held.get(t, 0)
            tf = F.col(f"_tf{i}")
            idf = max(LEAST_IDF, math.log((total - df + 0.5) / (df + 0.5))) if total else LEAST_IDF
            score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
        page = matched.where(F.forall(F.array(*[f"_tf{i}" for i in range(len(wanted))]), lambda x: x.isNotNull())).withColumn("_bm25", F.round(score, 9)).orderBy(F.desc("_bm25"), "key").limit(offset + limit)
        ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_bm25"), "key")).cast("long")).where(F.col("rank") > offset)
        return ranked.select("key", "session_id", "seq", "rank", (F.lit(1.0) / F.col("rank")).alias("score"))


def similarities(rows: DataFrame, kept: list[str], vector: str, query: list[float], dimensions: int) -> DataFrame:
    """``kept`` and ``score`` of the rows whose vector has a finite cosine to ``query``: a matrix product for each Arrow batch; 0 for the zero vector."""
    asked = np.asarray(query_vector(query, dimensions), dtype=np.float64)
    unit = asked / np.sqrt((asked * asked).sum())

    def run(batches):
        for batch in batches:
            whole = batch.filter(pc.equal(pc.list_value_length(batch.column(batch.schema.get_field_index(vector))), dimensions))
            if not whole.num_rows:
                continue
            grid = whole.column(whole.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            with np.errstate(all="ignore"):
                size = np.sqrt((grid * grid).sum(axis=1))
                score = np.where(size == 0, 0.0, grid @ unit / np.where(size == 0, 1.0, size))
            good = pa.array(np.isfinite(score) & (np.abs(score) <= 1.01))
            yield pa.RecordBatch.from_arrays([*[whole.column(whole.schema.get_field_index(c)) for c in kept], pa.array(score)], names=[*kept, "score"]).filter(good)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, vector).mapInArrow(run, f"{fields}, score double")


def semantic_search(store: Store, model: str, query: list[float], limit: int = 20, offset: int = 0, where: Column | None = None, dimensions: int = 64) -> DataFrame:
    """What ``vector_search`` gives over the live vectors of a model, measured where they are read: no vector is shuffled, only its similarity."""
    about = ["vec_rowid", "session_id", "seq", "role", "content_hash"]
    rows = table(store.spark, store.base, "message_vectors").where(F.col("model") == model)
    scored = similarities(rows if where is None else rows.where(where), about, "vector", query, dimensions)
    schema = "vec_rowid bigint, session_id string, seq bigint, role string, content_hash string, score double"
    need = offset + limit
    most = 2 * need + 16
    while True:
        # a page of the best, of which stale ones and re-deliveries fall out; were there too few left, a longer one
        best = scored.orderBy(F.desc("score"), "session_id", "seq", "vec_rowid").limit(most).collect()
        front = store.spark.createDataFrame(list({r["vec_rowid"]: tuple(r) for r in best}.values()), schema)
        messages = table(store.spark, store.base, "messages").where(searchable()).select("session_id", "seq", "role", "content_hash", "event_id")
        live = messages.join(F.broadcast(front), ["session_id", "seq", "role", "content_hash"]).select(F.coalesce("event_id", F.concat_ws(":", "session_id", F.col("seq").cast("string"))).alias("key"), "session_id", "seq", "score", "vec_rowid").distinct().collect()
        if len(best) < most or len(live) >= need:
            break
        most *= 4
    order = sorted(((-r["score"], r["session_id"], r["seq"], r["key"]) for r in live))[offset:need]
    page = [(key, session, seq, offset + i, -score) for i, (score, session, seq, key) in enumerate(order, 1)]
    return store.spark.createDataFrame(page, "key string, session_id string, seq bigint, rank bigint, score double")


def live_vectors(store: Store, model: str) -> DataFrame:
    """``key, session_id, seq, role, project_key, provider, vector`` of a model's vectors whose message still says the same."""
    vectors = store.rows("message_vectors", "session_id", "seq", "role", "content_hash", "project_key", "provider", "vector", where=F.col("model") == model)
    messages = store.rows("messages", "seq", "role", "content_hash", where=searchable())
    on = ["session_id", "seq", "role", "content_hash"]
    return vectors.join(messages, on).withColumn("key", F.coalesce("event_id", F.concat_ws(":", "session_id", F.col("seq").cast("string")))).select("key", "session_id", "seq", "role", "project_key", "provider", "vector")


def vector_search(vectors: DataFrame, query: list[float], limit: int = 20, offset: int = 0, where: Column | None = None, dimensions: int = 64) -> DataFrame:
    """``key, session_id, seq, rank, score``: the vectors most similar to ``query`` by cosine, ties by session and seq.

    An exact scan: similarity in the JVM, the best of each partition kept by the top-k of the sort. Vectors
    of another length or without a finite similarity drop out.
    """
    asked = query_vector(query, dimensions)
    length = math.sqrt(sum(x * x for x in asked))
    unit = F.array(*[F.lit(float(x)) for x in asked])
    rows = vectors.where(F.size("vector") == dimensions)
    if where is not None:
        rows = rows.where(where)
    size = norm(F.col("vector"))
    similarity = F.when(size > 0, dot(F.col("vector"), unit) / (size * F.lit(length))).otherwise(F.lit(0.0))
    scored = rows.select("key", "session_id", "seq", similarity.alias("score")).where(~F.isnan("score") & (F.abs("score") <= 1.01))
    page = scored.orderBy(F.desc("score"), "session_id", "seq").limit(offset + limit)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "session_id", "seq")).cast("long")).where(F.col("rank") > offset)
    return ranked.select("key", "session_id", "seq", "rank", "score")


def candidates(limit: int, offset: int) -> int:
    """How many rows of each list a fused page looks at."""
    return max(offset + limit + 1, LEAST_CANDIDATES)


def fuse(lexical: DataFrame, semantic: DataFrame | None, limit: int = 20, offset: int = 0) -> DataFrame:
    """``key, rank, score, degraded``: reciprocal-rank fusion of two ranked lists, ties by key.

    Each list is cut to the candidates of the page; a key in both adds up. Without a semantic list the
    lexical one stands alone and the rows say so.
    """
    most = candidates(limit, offset)
    lists = [x.where(F.col("rank") <= most).select("key", "rank") for x in (lexical, semantic) if x is not None]
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    fused = both.groupBy("key").agg(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("score"))
    page = fused.orderBy(F.desc("score"), "key").limit(offset + limit)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long")).where(F.col("rank") > offset)
    return ranked.select("key", "rank", "score", F.lit(semantic is None).alias("degraded"))


def hydrate(hits: DataFrame, store: Store, where: Column | None = None) -> DataFrame:
    """The hits of a page with their messages, in the order of the hits; ``where`` filters once more, so the page may be short."""
    messages = store.rows("messages", "seq", "role", "text", "project_key", "model", where=searchable()).withColumn("key", F.coalesce("event_id", F.concat_ws(":", "session_id", F.col("seq").cast("string"))))
    joined = hits.select("key", "rank", "score").join(messages, "key")
    return (joined if where is None else joined.where(where)).orderBy("rank")


def hit_rates(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``n_queries, hit_at_1, hit_at_3, hit_at_10, misses`` of ranked ``results`` (query_id, rank, text) against ``expected`` (query_id, term).

    A query hits at the first rank whose text has any of its expected terms.
    """
    found = results.join(expected, "query_id").where(F.instr(F.lower("text"), F.lower("term")) > 0).groupBy("query_id").agg(F.min("rank").alias("_first"))
    all_queries = expected.select("query_id").distinct().join(found, "query_id", "left")
    at = lambda k: F.sum(F.coalesce((F.col("_first") <= k).cast("long"), F.lit(0)))
    return all_queries.agg(F.count("*").alias("n_queries"), at(1).alias("hit_at_1"), at(3).alias("hit_at_3"), at(10).alias("hit_at_10"), F.sum(F.col("_first").isNull().cast("long")).alias("misses"))
