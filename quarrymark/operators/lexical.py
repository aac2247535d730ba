"""Lexical retrieval: postings, term statistics, BM25.

Term frequencies are counted inside the document's row and terms nobody asks for are dropped before anything is shuffled; only
the k best rows of each query leave a task of the final ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymark.config import RETRIEVAL
from quarrymark.functions.text import analyse, let, terms
from quarrymark.operators.rank import top_k
from quarrymark.sources.tables import spread


def analysed(docs: DataFrame, key: str = "doc_id", text: str = "text", analyser=analyse) -> DataFrame:
    """(key, terms array, length)."""
    tokens = spread(docs.select(key, text), key).select(key, analyser(F.col(text)).alias("tokens"))
    return tokens.withColumn("dl", F.size("tokens"))


def counted(tokens: Column) -> Column:
    """Distinct terms of one document with their counts: run lengths of the sorted terms."""

    def runs(ts: Column) -> Column:
        n = F.size(ts)
        every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        first = F.filter(every, lambda i: (i == 1) | (F.element_at(ts, i) != F.element_at(ts, F.greatest(i - 1, F.lit(1)))))
        return let(
            first,
            lambda st: F.transform(
                st,
                lambda i, k: F.struct(
                    F.element_at(ts, i).alias("term"),
                    (F.coalesce(F.try_element_at(st, k + 2), n + 1) - i).cast("long").alias("tf"),
                ),
            ),
        )

    return let(F.array_sort(tokens), runs)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, dl, term, tf); a vocabulary keeps only the terms somebody asks for.

    A document is counted inside its own row, so building postings shuffles nothing.
    """
    rows = analysed(docs, key, text).select(key, "dl", F.explode(counted(F.col("tokens"))).alias("p"))
    rows = rows.select(key, "dl", "p.term", "p.tf")
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("term").distinct(), "term", "left_semi").select(key, "dl", "term", "tf")
    return rows


class Corpus:
    """What ranking needs to know of the documents: counted from the texts, or read from an index (``sources.index``)."""

    def postings(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """(doc_id, dl, term, tf)."""
        raise NotImplementedError

    def frequencies(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """(term, df, cf)."""
        raise NotImplementedError

    def size(self) -> Column:
        raise NotImplementedError

    def mean_length(self) -> Column:
        raise NotImplementedError

    def with_idf(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """(term, df, cf, idf)."""
        return self.frequencies(vocabulary).withColumn("idf", idf(F.col("df"), self.size()))


class Texts(Corpus):
    """Counts the texts anew."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        self.docs, self.key, self.text = docs, key, text

    def postings(self, vocabulary: DataFrame | None = None) -> DataFrame:
        return postings(self.docs, self.key, self.text, vocabulary)

    def frequencies(self, vocabulary: DataFrame | None = None) -> DataFrame:
        return document_frequency(self.postings(vocabulary))

    def size(self) -> Column:
        return self.docs.agg(F.count(F.lit(1))).scalar()

    def mean_length(self) -> Column:
        return analysed(self.docs, self.key, self.text).agg(F.avg("dl")).scalar()


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, idf_: Column, avg_dl: Column, k1: float = RETRIEVAL.k1, b: float = RETRIEVAL.b) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def query_terms(queries: DataFrame, key: str = "qid", text: str = "query") -> DataFrame:
    """(key, term): distinct terms of every query."""
    return queries.select(key, F.explode(terms(F.col(text))).alias("term"))


def bm25_scores(corpus: Corpus, queries: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score > 0) of every matching pair; ``only`` restricts the documents and changes no weight.

    Catalyst broadcasts the query terms when they are small and falls back to a sorted join when not.
    """
    asked = query_terms(queries)
    weighted = asked.join(corpus.with_idf(asked), "term").select("qid", "term", "idf")
    score = weight(F.col("tf"), F.col("dl"), F.col("idf"), corpus.mean_length())
    found = corpus.postings(asked)
    if only is not None:
        found = found.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    return (
        found.join(weighted, "term")
        .select("qid", "doc_id", score.alias("w"))
        .groupBy("qid", "doc_id")
        .agg(F.round(F.sum("w"), 6).alias("score"))
        .where(F.col("score") > 0)
    )


def bm25_top(corpus: Corpus, queries: DataFrame, k: int = RETRIEVAL.top_k, only: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) over all matching pairs: ties by document id.

    For short queries an index finds the same by ``search`` and opens few blocks; whole passages reach nearly all of them.
    """
    return top_k(bm25_scores(corpus, queries, only), ["qid"], F.col("score").desc(), F.col("doc_id").asc(), k=k)


def cooccurrence(corpus: Corpus, needs: DataFrame, key: str = "need_id") -> DataFrame:
    """Documents that contain all terms of ``all_of`` and at least one of ``any_of``, counted per need."""
    want = needs.select(
        key,
        F.size("all_of").alias("n_all"),
        F.explode(
            F.concat(
                F.transform("all_of", lambda t: F.struct(t.alias("term"), F.lit(True).alias("must"))),
                F.transform("any_of", lambda t: F.struct(t.alias("term"), F.lit(False).alias("must"))),
            )
        ).alias("w"),
    ).select(key, "n_all", "w.term", "w.must")
    hits = (
        corpus.postings(want)
        .join(want, "term")
        .groupBy(key, "doc_id", "n_all")
        .agg(F.count_if("must").alias("n_must"), F.count_if(~F.col("must")).alias("n_any"))
        .where((F.col("n_must") == F.col("n_all")) & (F.col("n_any") > 0))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    return needs.select(key).join(hits, key, "left").select(key, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
