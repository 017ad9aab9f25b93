"""Lexical ranking: postings, document frequency, BM25, and the best chunk of an entry."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..session import spread, stored


def _counted(key: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, tf, dl = [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                toks = T.token_list(text)
                counts = Counter(toks)
                at += [row] * len(counts)
                terms += counts
                tf += counts.values()
                dl += [len(toks)] * len(counts)
            keys = [b.column(k).take(pa.array(at, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int32())], names=[*key, "term", "tf", "dl"])

    return run


def postings(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., term, tf, dl): each document's terms, counted in one Arrow pass over the documents, so no shuffle."""
    rows = spread(docs.select(*key, F.col(text).alias("text")))
    schema = StructType([*[rows.schema[k] for k in key], StructField("term", StringType()), StructField("tf", LongType()), StructField("dl", IntegerType())])
    return rows.mapInArrow(_counted(key), schema)


def doc_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: the number of documents, and the mean number of tokens (documents without tokens included)."""
    return docs.agg(F.count(F.lit(1)).alias("ndoc"), F.avg(F.size(T.tokens(text))).alias("avgdl"))


def idf(df: Column, ndoc: Column) -> Column:
    return F.log(1 + (ndoc - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.when(avgdl == 0, 1).otherwise(avgdl)))


def bm25(terms: DataFrame, docs: DataFrame, doc_key: str, query_key: str | None = None, k1: float = 1.2, b: float = 0.75, stopword_df: float = 0.0, text: str = "text") -> DataFrame:
    """([query_key,] doc_key, score) of documents against query terms ([query_key,] term [, weight]).

    Terms in more than ``stopword_df`` of the documents are dropped if it is above 0. Only postings of asked terms reach the join:
    the distinct terms are a semi join before the term frequencies are shuffled.
    """
    asked = terms if "weight" in terms.columns else terms.withColumn("weight", F.lit(1.0))
    asked = asked.filter(F.col("weight") > 0).dropDuplicates([*([query_key] if query_key else []), "term"])
    stats = docs.agg(F.count(F.lit(1)).alias("ndoc"), F.avg(F.size(T.tokens(text))).alias("avgdl"))  # one row
    post = stored(postings(docs, [doc_key], text).join(asked.select("term").distinct(), "term", "left_semi"), "asked-postings")  # read for frequencies and for scores
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.join(F.broadcast(stats)).filter((F.lit(stopword_df) <= 0) | (F.col("df") <= F.lit(stopword_df) * F.col("ndoc")))
    weighed = weighed.select("term", idf(F.col("df"), F.col("ndoc")).alias("idf"), "avgdl")
    scored = post.join(weighed, "term").join(asked, "term")
    score = F.sum(F.col("idf") * F.col("weight") * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    return scored.groupBy(*([query_key] if query_key else []), doc_key).agg(score.alias("score"))


def _chunks(mode: str, size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c.strip()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, c in enumerate(T.chunk_entry(t, mode, size, least)) if c.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["entry_id", "pos", "text"])

    return run


def chunks(entries: DataFrame, mode: str = "paragraph", size: int = 1750, least: int = 120) -> DataFrame:
    """(entry_id, pos, text): the pieces of each entry's content."""
    return spread(entries.select("entry_id", "content")).mapInArrow(_chunks(mode, size, least), "entry_id long, pos int, text string")


def best_chunk(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """One row a key with its best score and the row that had it; the aggregate stands before any limit."""
    rest = [c for c in scores.columns if c not in keys]
    return scores.groupBy(*keys).agg(F.max(F.struct(F.col(score), *[c for c in rest if c != score])).alias("b")).select(*keys, "b.*")


def bm25_entries(terms: DataFrame, entries: DataFrame, query_key: str | None = None, **kw) -> DataFrame:
    """BM25 over chunks, an entry taking the score of its best chunk; k1, b and stopword_df as in ``bm25``."""
    pieces = chunks(entries).withColumn("chunk", F.concat_ws("/", "entry_id", "pos"))
    scores = bm25(terms, pieces, "chunk", query_key, **kw).withColumn("entry_id", F.split("chunk", "/")[0].cast("long"))
    return best_chunk(scores, [*([query_key] if query_key else []), "entry_id"]).drop("chunk")


def gazetteer(entries: DataFrame) -> DataFrame:
    """(term): every token of an entry's keys, secondary keys and title."""
    texts = F.array_compact(F.concat(F.coalesce("key", F.array()), F.coalesce("keysecondary", F.array()), F.array("comment")))
    return entries.select(F.explode(texts).alias("s")).select(F.explode(T.tokens("s")).alias("term")).distinct()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(q, w) for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in sorted(T.name_words(T.ortho_text(t)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["id", "term"])


def names(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): the words each text uses as names."""
    return texts.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(_names, "id string, term string").withColumnRenamed("id", key)


def weighted_terms(queries: DataFrame, gazetteer_terms: DataFrame, boost: float = 3.0, key: str = "chat_id", text: str = "query") -> DataFrame:
    """(key, term, weight): query terms that are names (weight ``boost``) or in the gazetteer (weight 1); others are dropped."""
    toks = queries.select(key, F.explode(F.array_distinct(T.tokens(text))).alias("term"))
    named = names(queries, key, text).withColumn("named", F.lit(True))
    known = gazetteer_terms.withColumn("known", F.lit(True))
    weighed = toks.join(named, [key, "term"], "left").join(known, "term", "left")
    return weighed.filter("named OR known").select(key, "term", F.when(F.col("named"), float(boost)).otherwise(1.0).alias("weight"))


def name_idf(entries: DataFrame) -> DataFrame:
    """(world, term, df, ndoc): names by the entries of their book that hold them; disabled entries count too."""
    filled = entries.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    docs = filled.groupBy("world").agg(F.count(F.lit(1)).alias("ndoc"))
    owned = names(filled, "entry_id", "content").select(F.col("entry_id").cast("long").alias("entry_id"), "term").join(filled.select("entry_id", "world"), "entry_id")
    return owned.groupBy("world", "term").agg(F.count(F.lit(1)).alias("df")).join(docs, "world")


QUERY_ROWS = 200_000  # (query, term) rows that one pass over the documents scores; more go in further passes


def _frequencies(vocabulary: frozenset[str]):
    """(term, n): documents that hold each asked term; '' counts the documents, null their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        docs = tokens = 0
        for b in batches:
            for text in b.column("text").to_pylist():
                toks = T.token_list(text)
                docs, tokens = docs + 1, tokens + len(toks)
                df.update(vocabulary.intersection(toks))
        rows = [("", docs), (None, tokens), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    return run


def _top(ids: np.ndarray, of_term: dict[str, tuple[np.ndarray, np.ndarray]], avgdl: float, k: int, k1: float, b: float, places: int):
    """The k best documents of each query in a task; of_term: the queries (by place in ids) that ask a term and what it weighs in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, own = np.zeros((0, len(ids))), np.zeros((0, len(ids)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = np.zeros((part.num_rows, len(ids)))
                for row, text in zip(scores, part.column("text").to_pylist()):
                    toks = T.token_list(text)
                    norm = k1 * (1 - b + b * len(toks) / (avgdl or 1))
                    for term, tf in Counter(toks).items():
                        if (hit := of_term.get(term)) is not None:
                            row[hit[0]] += hit[1] * (tf * (k1 + 1) / (tf + norm))
                scores = np.floor(scores * 10**places + 0.5) / 10**places
                best = np.vstack([best, scores])
                own = np.vstack([own, np.broadcast_to(part.column("doc").to_numpy(zero_copy_only=False)[:, None], scores.shape)])
                order = np.lexsort((own, -best), axis=0)[:k]
                best, own = np.take_along_axis(best, order, 0), np.take_along_axis(own, order, 0)
        keep = best > 0
        query = np.broadcast_to(ids, best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(own[keep]), pa.array(best[keep])], names=["query", "doc", "score"])

    return run


def bm25_top(terms: DataFrame, docs: DataFrame, doc_key: str, query_key: str, k: int, k1: float = 1.2, b: float = 0.75, stopword_df: float = 0.0, text: str = "text", places: int = 5) -> DataFrame:
    """(query_key, doc_key, score, rank): the k best documents of each query (query_key, term) by BM25, scores to ``places``, equal ones by document.

    The stated query set goes over the documents in blocks of QUERY_ROWS. A task keeps k documents a query, so a term that many documents and
    queries share makes no pairs to shuffle; keys are longs.
    """
    rows = spread(docs.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text")))
    asked = terms.select(F.col(query_key).cast("long").alias("q"), "term").dropna().distinct()
    blocks = -(-asked.count() // QUERY_ROWS)
    out = rows.sparkSession.createDataFrame([], "query long, doc long, score double")
    for i in range(blocks):
        part: dict[str, list[int]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect():  # about QUERY_ROWS rows
            part.setdefault(r.term, []).append(r.q)
        df = {r.term: r.n for r in rows.mapInArrow(_frequencies(frozenset(part)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, tokens = df.pop("", 0), df.pop(None, 0)
        ids = np.array(sorted({q for qs in part.values() for q in qs}), np.int64)
        weigh = lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5))
        of_term = {t: (np.searchsorted(ids, qs), np.full(len(qs), weigh(df[t]))) for t, qs in part.items() if df.get(t) and (stopword_df <= 0 or df[t] <= stopword_df * n)}
        found = rows.mapInArrow(_top(ids, of_term, tokens / n if n else 0.0, k, k1, b, places), "query long, doc long, score double")
        out = found if i == 0 else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_key), F.col("doc").alias(doc_key), "score", "rank")
