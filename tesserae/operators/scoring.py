"""BM25 of all documents against a bounded number of questions, by groups of documents.

A document's tokens are counted where it is read, those of asked terms alone are
exchanged with its length, by groups of some thousand documents. From this one exchange
come the mean length, the document frequencies and the scores, so texts are cut into
tokens once; a group's scores are products with its questions' terms, and only its
best rows leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.batches import pieces
from tesserae.operators.nearest import MARGIN, first_of, rounded

#: Documents of a group on average, questions that are scored at once, documents of a product.
DOCUMENTS, BLOCK, CUT = 4000, 256, 6000
#: Tokens that are counted at once.
TOKENS = 500_000
#: In place of a term's code: the tokens of all documents.
ALL = -1


def counted(tokens: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code (place in ``terms``) and number of each asked term of each row, by row."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[codes >= 0]
    keys, tf = np.unique(at * max(len(terms), 1) + codes[codes >= 0], return_counts=True)
    return keys // max(len(terms), 1), keys % max(len(terms), 1), tf


def term_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """``term, id, length, tf`` of each row by itself, counted where it is read; nothing is exchanged."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), TOKENS):
                ids, cut = batch.columns
                lengths = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
                words = cut.flatten().dictionary_encode()
                n = max(len(words.dictionary), 1)
                keys, tf = np.unique(np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * n + words.indices.to_numpy(), return_counts=True)
                at = keys // n
                columns = [words.dictionary.take(pa.array(keys % n)), ids.take(pa.array(at)), pa.array(lengths[at].astype(np.int32)), pa.array(tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "id", "length", "tf"])

    return docs.select("id", tokens.alias("tokens")).mapInArrow(run, f"term string, id {kind}, length int, tf long")


def _lists(at: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=n))].astype(np.int32)), pa.array(values.astype(np.int32)))


def asked_counts(docs: DataFrame, tokens: Column, terms: pa.Array, groups: int) -> DataFrame:
    """``part, id, length, codes, tfs`` of all documents; the lists are empty where no term is asked."""
    held = docs.sparkSession.sparkContext.broadcast(terms)
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, pc.fill_null(pc.list_value_length(whole.column(2)), 0).to_numpy(zero_copy_only=False), TOKENS):
                part, ids, cut = batch.columns
                at, codes, tf = counted(cut, held.value)
                lengths = pc.fill_null(pc.list_value_length(cut), 0).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([part, ids, lengths, _lists(at, batch.num_rows, codes), _lists(at, batch.num_rows, tf)], ["part", "id", "length", "codes", "tfs"])

    rows = docs.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"), "id", tokens.alias("tokens"))
    return rows.mapInArrow(run, f"part int, id {kind}, length int, codes array<int>, tfs array<int>")


def _postings(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of a group, and document, length, code and tf of its postings; rows that agree in id and length are one document."""
    ids = table["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    code, tf = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("codes", "tfs"))
    sizes = pc.list_value_length(table["codes"]).to_numpy()
    of = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    length = np.repeat(table["length"].to_numpy().astype(np.int64), sizes)
    order = np.lexsort((code, length, of))
    of, length, code, tf = of[order], length[order], code[order], tf[order]
    if len(of):
        begins = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(length) != 0) | (np.diff(code) != 0)])
        of, length, code, tf = of[begins], length[begins], code[begins], np.add.reduceat(tf, begins)
    return ids.dictionary, of, length, code, tf


def _frequencies(table: pa.Table) -> pa.Table:
    codes, n = np.unique(_postings(table)[3], return_counts=True)
    n = np.r_[table["length"].to_numpy().sum(dtype=np.int64), n]
    return pa.table({"code": pa.array(np.r_[ALL, codes].astype(np.int32)), "df": pa.array(n.astype(np.int64))})


def _best(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best of each column that share a term at all."""
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.zeros(scores.shape[1])
    row, column = np.nonzero((scores > 0) & (scores >= least - MARGIN))
    table = pa.table({"q": column, "key": rounded(scores[row, column]), "id": ids.take(pa.array(row)), "row": row})
    table = table.take(pc.sort_indices(table, [("q", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start"))
    keep = first_of(table["q"].to_numpy(), k) if len(row) else np.zeros(0, bool)
    return table["row"].to_numpy()[keep], table["q"].to_numpy()[keep]


def _ranked(ids: pa.Array, of: np.ndarray, code: np.ndarray, weight: np.ndarray, questions: pa.Array, asked: np.ndarray, code_of: np.ndarray, idf: np.ndarray, k: int) -> pa.Table:
    """The best ``k`` documents of each question; postings by document, questions' terms as places in ``questions``, codes and ``idf``."""
    out = []
    for first in range(0, len(questions), BLOCK):
        mine = (asked >= first) & (asked < first + BLOCK)
        used, place = np.unique(code_of[mine], return_inverse=True)
        wants = np.zeros((len(used), min(BLOCK, len(questions) - first)))
        wants[place, asked[mine] - first] = idf[mine]
        at = np.minimum(np.searchsorted(used, code), max(len(used) - 1, 0))
        for low in range(0, len(ids), CUT):  # a product of some documents at a time
            here = (of >= low) & (of < low + CUT)
            here[here] = used[at[here]] == code[here] if len(used) else False
            scores = np.zeros((min(CUT, len(ids) - low), wants.shape[1]))
            docs_here, at_here, w = of[here] - low, at[here], weight[here]
            begins = np.searchsorted(docs_here, np.arange(len(scores) + 1))
            for i in np.flatnonzero(np.diff(begins)):
                s = slice(begins[i], begins[i + 1])
                scores[i] = w[s] @ wants[at_here[s]]
            row, column = _best(ids.slice(low, len(scores)), scores, k)
            out.append(pa.table({"qid": questions.take(pa.array(column + first)), "id": ids.take(pa.array(row + low)), "score": scores[row, column]}))
    return pa.concat_tables(out) if out else pa.table({"qid": questions.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})


def best_scores(docs: DataFrame, tokens: Column, wanted: pa.Table, kind: str, k: int, n: int, k1: float, b: float) -> DataFrame:
    """``qid, id, score`` (not rounded): all of each question's ``k`` best, and some more. ``wanted``: qid, term, for ``n`` documents."""
    terms = pc.unique(wanted["term"].combine_chunks())
    groups = -(-n // DOCUMENTS) or 1
    spark = docs.sparkSession
    qids = wanted["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
    held = spark.sparkContext.broadcast((qids.dictionary, qids.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.index_in(wanted["term"].combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)))
    width = len(terms)
    each = asked_counts(docs, tokens, terms, groups)
    found = each.groupBy("part").applyInArrow(_frequencies, "code int, df long").groupBy("code").agg(F.sum("df").alias("df"))
    known = spark.range(groups).select(F.col("id").cast("int").alias("part")).join(F.broadcast(found))  # the asked terms and the tokens of all, for each group

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        questions, asked, code_of = held.value
        ids, of, length, code, tf = _postings(left)
        codes, counts = right["code"].to_numpy(), right["df"].to_numpy()
        average = counts[codes == ALL].sum() / n
        df = np.zeros(width)
        df[codes[codes != ALL]] = counts[codes != ALL]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        penalty = k1 * ((1 - b) + b * length / average) if average > 0 else float(k1)
        weight = tf * (k1 + 1) / (tf + penalty)
        return _ranked(ids, of, code, weight, questions, asked, code_of, idf[code_of], k)

    return each.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, f"qid {kind}, id {dict(docs.dtypes)['id']}, score double")


def best_of_ranges(blocks: DataFrame, chosen: DataFrame, rated: pa.Table, kind: str, k: int) -> DataFrame:
    """``qid, id, score`` (not rounded): the best ``k`` of each question in each range ``chosen`` for it.

    ``blocks``: term, range, postings, where all postings of a document lie in one
    range; ``chosen``: qid, range; ``rated``: qid, term, idf.
    """
    terms = pc.unique(rated["term"].combine_chunks())
    qids = rated["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
    of_term = pc.index_in(rated["term"].combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
    held = blocks.sparkSession.sparkContext.broadcast((terms, qids.dictionary, qids.indices.to_numpy(zero_copy_only=False).astype(np.int64), of_term, rated["idf"].to_numpy()))
    inner = dict(blocks.select(F.col("postings.id").alias("id")).dtypes)["id"][len("array<") : -1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, questions, asked, code_of, idf = held.value
        lists = left["postings"].combine_chunks()
        flat = lists.flatten()
        ids = flat.field("id").dictionary_encode(null_encoding="encode")
        of = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.repeat(pc.index_in(left["term"].combine_chunks(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.lexsort((code, of))
        mine = np.isin(asked, pc.index_in(right["qid"].combine_chunks(), value_set=questions).to_numpy(zero_copy_only=False))
        return _ranked(ids.dictionary, of[order], code[order], flat.field("weight").to_numpy()[order], questions, asked[mine], code_of[mine], idf[mine], k)

    return blocks.groupBy("range").cogroup(chosen.select("qid", F.col("range").alias("of_range")).groupBy("of_range")).applyInArrow(run, f"qid {kind}, id {inner}, score double")
