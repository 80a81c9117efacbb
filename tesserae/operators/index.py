"""Indexes that are built once, kept in folders, and searched without reading the corpus again.

Vectors lie in lists by their nearest centroid; a search reads the lists near its
questions. Postings lie in blocks of one term and one range of documents, with the
most that a document of the block can score; a search reads the blocks of its terms,
and of these only ranges that can still change the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import tokenize
from tesserae.operators import retrieval as R
from tesserae.operators.nearest import in_lists, nearest_lists
from tesserae.operators.scoring import best_of_ranges
from tesserae.session import few, sent

#: Vectors that centroids are fitted on at most, and that the number of lists to search is measured with.
SAMPLE, MEASURED = 20_000, 256
#: Documents of a range, and folders that terms are dealt to.
RANGE_BITS, TERM_BUCKETS = 7, 64
#: Documents whose blocks are made at once.
WORK = 2048


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def _nearest(rows: DataFrame, centroids: np.ndarray, vector: str, keep: int | None = None) -> DataFrame:
    """Rows with ``list``, or with ``lists``, the ``keep`` nearest in order: by cosine, a product of each batch with all centroids."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # as many as there are lists
    kind = "int" if keep is None else "array<int>"
    out = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, {'list' if keep is None else 'lists'} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            x = batch.column(vector).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            near = x @ c.T
            told = pa.array(near.argmax(axis=1).astype(np.int32)) if keep is None else pa.array(nearest_lists(x, c, keep).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, told], [*batch.schema.names, "list" if keep is None else "lists"])

    return rows.mapInArrow(run, out)


def fitted_centroids(x: np.ndarray, lists: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids of some vectors by cosine; they begin at vectors spread over the sample, and one that loses all vectors stays."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[np.unique(np.linspace(0, len(x) - 1, lists).astype(int))]
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(axis=1), x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def build_vector_lists(vectors: DataFrame, path: str, lists: int | None = None, k: int = R.K, recall: float = 0.95, sample: int = SAMPLE, measured: int = MEASURED) -> dict:
    """Writes ``id, vector`` and all other columns to ``lists`` lists below ``path``; gives what the index knows of itself.

    Centroids are fitted on at most ``sample`` vectors, every vector is put in a
    list. How many lists a search must read for the wanted ``recall`` of the ``k``
    nearest is measured with at most ``measured`` vectors, held against all of them
    exactly. Null vectors are left out; vectors must be of one length.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vector is not null")
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), 4096, n))
    some = lambda most, salt: rows.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, -(-n // most)))) == 0)
    held = some(sample, 1).orderBy("id").limit(2 * sample).select("vector").toArrow().column("vector").to_pylist() or [r["vector"] for r in rows.limit(1).collect()]
    centroids = fitted_centroids(np.array(held or [[0.0]], np.float64), lists)
    lists = len(centroids)
    _nearest(rows, centroids, "vector").hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    # of sampled vectors, where in the order of lists their true neighbours lie
    asked = some(measured, 2).limit(2 * measured).select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    stored = spark.read.parquet(f"{path}/lists") if n else rows.withColumn("list", F.lit(0))
    found = R.dense_topk(stored.select("id", "vector", "list"), asked, k, carry=("list",)).select("qid", F.col("list").alias("of"))
    place = found.join(_nearest(asked, centroids, "query", lists).select("qid", "lists"), "qid").select(F.array_position("lists", F.col("of")).alias("place"))
    share, probes, total = 0, lists, place.count()
    for place, count in sorted(map(tuple, place.groupBy("place").count().collect())):  # a row a list
        share += count
        if share >= recall * total:
            probes = int(place)
            break
    about = {"rows": n, "lists": lists, "probes": probes, "recall": recall, "k": k}
    _write_json(spark, f"{path}/about", about)
    return about


def search_vector_lists(spark: SparkSession, path: str, questions: DataFrame, k: int = R.K, probes: int | None = None) -> DataFrame:
    """``qid, id, score, rank`` of ``qid, query``: exact cosine among the vectors of each question's nearest lists.

    Only the lists that some question needs are read: they are folders, so files of
    others are pruned. With as many probes as lists it is the exact search.
    """
    about = _read_json(spark, f"{path}/about")
    probes = min(probes or about["probes"], about["lists"])
    if not about["rows"]:
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # 4,096 at most
    stored = spark.read.parquet(f"{path}/lists").select("id", "vector", "list")
    if probes == about["lists"]:
        return R.dense_topk(stored, questions.select("qid", "query"), k)
    near = _nearest(questions.select("qid", "query"), centroids, "query", probes).select(F.explode("lists").alias("list")).distinct()
    needed = sorted(r["list"] for r in near.collect())  # 4,096 at most
    if len(needed) < about["lists"]:
        stored = stored.where(F.col("list").isin(needed))
    found = in_lists(stored, questions, k, centroids, probes)
    return R.top(found.select("qid", "id", F.round("cosine", R.DIGITS).alias("score")), k, F.desc("score"), F.asc("id"))


def _blocks(rows: pa.RecordBatch, average: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """``term, range, most, n, postings`` of some documents: their first 128 are a range, and so on; a range is named after its first document."""
    ids, tokens, numbers = rows.columns
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    if not len(words):
        return
    width, height = len(words.dictionary), 1 << RANGE_BITS
    doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    keys, tf = np.unique(((doc >> RANGE_BITS) * width + words.indices.to_numpy().astype(np.int64)) * height + doc % height, return_counts=True)
    block, doc = keys // height, (keys // height // width) * height + keys % height
    penalty = k1 * ((1 - b) + b * lengths[doc] / average) if average > 0 else float(k1)
    weight = tf * (k1 + 1) / (tf + penalty)
    begins = np.flatnonzero(np.r_[True, np.diff(block) != 0])
    ends = np.r_[begins, len(block)].astype(np.int32)
    postings = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(weight)], ["id", "weight"]))
    first = numbers.to_numpy()[(block[begins] // width) * height]
    columns = [words.dictionary.take(pa.array(block[begins] % width)), pa.array(first), pa.array(np.maximum.reduceat(weight, begins)), pa.array(np.diff(ends).astype(np.int64)), postings]
    yield pa.RecordBatch.from_arrays(columns, ["term", "range", "most", "n", "postings"])


def build_term_blocks(docs: DataFrame, path: str, k1: float = R.K1, b: float = R.B) -> dict:
    """Writes the postings of ``id, text`` below ``path``: a row for each term and range of 128 documents, dealt to folders by term.

    A range's documents are neighbours where they are read, so its blocks are made there; only they are exchanged.
    """
    spark = docs.sparkSession
    n, average = R.corpus_stats(docs)
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, WORK) for i in range(0, batch.num_rows, WORK)):
                yield from _blocks(rows, average, k1, b)

    rows = docs.select("id", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("tokens"), F.monotonically_increasing_id().alias("range"))
    blocks = rows.mapInArrow(run, f"term string, range long, most double, n long, postings array<struct<id:{kind},weight:double>>")  # 128 postings at most
    folder = F.pmod(F.crc32("term"), F.lit(TERM_BUCKETS)).cast("int")
    blocks.withColumn("folder", folder).hint("rebalance", "folder").sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").parquet(f"{path}/blocks")
    about = {"documents": n, "average": average}
    _write_json(spark, f"{path}/about", about)
    return about


def search_term_blocks(spark: SparkSession, path: str, questions: DataFrame, k: int = R.K) -> DataFrame:
    """``qid, id, score, rank`` of ``qid, text``: the rows of `retrieval.bm25_topk`, from the index alone.

    The bounds of the blocks of a question's terms tell, for each range of
    documents, the most that one of them can score. The most promising ranges are
    scored first; the ``k``-th best score so far is a threshold, and of the other
    ranges only those whose bound reaches it are read.
    """
    about = _read_json(spark, f"{path}/about")
    wanted = R.query_terms(questions)
    if not about["documents"] or wanted.isEmpty():
        return spark.createDataFrame([], f"qid {dict(questions.dtypes)['qid']}, id long, score double, rank int")
    folders = sorted(r[0] for r in wanted.select(F.pmod(F.crc32("term"), F.lit(TERM_BUCKETS)).cast("int")).distinct().collect())  # 64 at most
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("folder").isin(folders))
    held = few(wanted)
    asked = F.broadcast(wanted) if held else wanted
    heads = blocks.select("term", "range", "most", "n").join(F.broadcast(wanted.select("term").distinct()) if held else wanted.select("term").distinct(), "term")
    idf = heads.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.log(1 + (F.lit(about["documents"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    rated = asked.join(idf, "term")
    if held:
        told = rated.select("qid", "term", "idf").toArrow()  # no more rows than the questions have terms
        rated = F.broadcast(spark.createDataFrame(told, rated.select("qid", "term", "idf").schema))
    bounds = heads.join(rated, "term").groupBy("qid", "range").agg(F.sum(F.col("most") * F.col("idf")).alias("bound"))
    ranked = R.top(bounds, None, F.desc("bound"), F.asc("range"))
    kind = dict(questions.dtypes)["qid"]

    def scored(chosen: DataFrame, some: bool = False) -> DataFrame:
        """A document's postings all lie in its range, so of each range only the best rows of a question are exchanged further."""
        if held:
            needed = blocks.select("term", "range", "postings").join(F.broadcast(rated.select("term").distinct()), "term")
            if some:
                needed = needed.join(sent(chosen.select("range").distinct(), questions, k), "range", "left_semi")
            return best_of_ranges(needed, chosen.select("qid", "range"), told, kind, k).withColumn("score", F.round("score", R.DIGITS))
        pairs = rated.join(chosen.select("qid", "range"), "qid")
        found = blocks.select("term", "range", "postings").join(pairs, ["term", "range"]).select("qid", "idf", F.explode("postings").alias("p"))
        return found.groupBy("qid", F.col("p.id").alias("id")).agg(F.round(F.sum(F.col("p.weight") * F.col("idf")), R.DIGITS).alias("score"))

    first = scored(ranked.where(F.col("rank") <= k), some=True)
    best = R.top(first, k, F.desc("score"), F.asc("id"))
    threshold = best.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = ranked.where(F.col("rank") > k).join(threshold, "qid", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 10.0**-R.DIGITS)
    return R.top(best.drop("rank").unionByName(scored(rest)), k, F.desc("score"), F.asc("id"))
