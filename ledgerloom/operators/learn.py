"""Category suggestions from rows that a person categorised: TF-IDF nearest neighbours, as joins.

The inverted index is the exploded (word, row) table of the examples. A query row
meets the examples by its rarest words alone (an example counts only if it has one
of them), so common words, which would pair everything with everything, are never
a join key; the similarity of the pairs found comes from their word vectors. Rows of
equal words and direction are one class from the start, of examples with the seven
smallest ids, as no answer needs more: a statement line that comes every month costs
what it costs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import telling_words
from .ingest import MOST_FOLDERS, VersionedTable

#: Least similarity, least share of the winner, neighbours.
SIMILAR, AGREED, NEIGHBOURS = 0.4, 0.75, 7


def _vectors(rows: DataFrame, df: DataFrame, size: DataFrame) -> DataFrame:
    """(id, word, v, df): each row's word weights, of length 1."""
    words = rows.select("id", F.explode(telling_words(F.col("description"))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    w = words.join(df, "word", "left").crossJoin(F.broadcast(size)).withColumn("df", F.coalesce("df", F.lit(0).cast("bigint")))
    w = w.withColumn("t", F.col("n") * (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1))
    return w.withColumn("v", F.col("t") / F.sqrt(F.sum(F.col("t") * F.col("t")).over(Window.partitionBy("id")))).select("id", "word", "v", "df", "size")


def word_counts(descriptions: DataFrame) -> DataFrame:
    """(word, n): in how many of the texts a word stands; with no word, how many texts have any."""
    texts = descriptions.select(F.array_distinct(telling_words(F.col("description"))).alias("w")).where(F.size("w") > 0)
    every = F.concat(F.array(F.lit(None).cast("string")), F.col("w"))
    return texts.select(F.explode(every).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class WordIndex:
    """What the learner knows, kept beside a ledger and growing with it: how many texts hold each word, and the rows that a person categorised.

    A batch adds its own counts, and the rows that it teaches take the place of
    older ones of the same id; no description is read twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.counts, self.taught = VersionedTable(spark, f"{path}/counts"), VersionedTable(spark, f"{path}/taught")

    def add(self, descriptions: DataFrame) -> None:
        """descriptions of new rows, taught or not, each of them once."""
        self.counts.add(word_counts(descriptions))
        if len(self.counts.folders()) > MOST_FOLDERS:
            self.counts.save(self.counts.read().groupBy("word").agg(F.sum("n").alias("n")))

    def teach(self, examples: DataFrame) -> None:
        """examples: id, description, money_in, category; without a category the row teaches no longer."""
        rows = examples.select("id", "description", "money_in", "category")
        self.taught.replace(rows.where("category is not null"), "id", gone=rows)

    def suggest(self, queries: DataFrame) -> DataFrame:
        """As suggest_categories, of all that was added and taught."""
        n = self.counts.read().groupBy("word").agg(F.sum("n").alias("df"))
        return _suggest(queries, self.taught.read(), n.where("word is not null"), n.where("word is null").select(F.col("df").alias("size")))


def suggest_categories(queries: DataFrame, examples: DataFrame, others: DataFrame) -> DataFrame:
    """(id, category, n_alike, example_id, similarity) for the queries that get one.

    queries: id, description, money_in. examples: id, description, money_in,
    category. others: description, further rows that tell common words. A word's
    weight is its count times ln((1 + N) / (1 + df)) + 1 over the N texts of
    examples and others that have words. An example is alike if money goes the
    same way, the similarity is 0.4 or more, and it has one of the query's rarest
    words, which must stand in at most half of the texts. Of the 7 most alike the
    category of most weight wins with 3/4 of it. Ties: the smaller example id,
    then the category first in the alphabet.
    """
    n = word_counts(examples.select("description").unionByName(others.select("description")))
    return _suggest(queries, examples, n.where("word is not null").withColumnRenamed("n", "df"), n.where("word is null").select(F.col("n").alias("size")))


def _suggest(queries: DataFrame, examples: DataFrame, df: DataFrame, size: DataFrame) -> DataFrame:
    """df: word, df. size: one row, how many texts there are."""
    key = F.array_join(F.array_sort(telling_words(F.col("description"))), " ")
    asked = queries.select("id", "description", "money_in", key.alias("key"))
    queries = asked.groupBy("key", "money_in").agg(F.min("id").alias("id"), F.min_by("description", "id").alias("description"))
    kind = ["key", "money_in", "category"]
    ranked = examples.select("id", "description", "money_in", "category", key.alias("key")).withColumn("n", F.row_number().over(Window.partitionBy(*kind).orderBy("id")))
    examples = ranked.where(F.col("n") <= NEIGHBOURS).groupBy(*kind).agg(F.min("id").alias("id"), F.min_by("description", "id").alias("description"), F.collect_list("id").alias("ids"))
    q, e = _vectors(queries, df, size), _vectors(examples, df, size)
    rarest = F.min("df").over(Window.partitionBy("id"))
    keys = q.withColumn("r", rarest).where((F.col("df") == F.col("r")) & (F.col("df") <= F.col("size") / 2) & (F.col("df") > 0)).select(F.col("id").alias("q"), "word")
    pairs = keys.join(e.select(F.col("id").alias("e"), "word"), "word").select("q", "e").distinct()
    ways = pairs.join(queries.select(F.col("id").alias("q"), F.col("money_in").alias("qi")), "q").join(examples.select(F.col("id").alias("e"), F.col("money_in").alias("ei"), "category"), "e").where("qi = ei")
    met = ways.select("q", "e", "category").join(q.select(F.col("id").alias("q"), "word", F.col("v").alias("qv")), "q").join(e.select(F.col("id").alias("e"), "word", F.col("v").alias("ev")), ["e", "word"])
    near = met.groupBy("q", "e", "category").agg(F.sum(F.col("qv") * F.col("ev")).alias("s")).where(F.col("s") >= SIMILAR)
    near = near.join(examples.select(F.col("id").alias("e"), "ids"), "e").select("q", "category", "s", F.explode("ids").alias("e"))
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.round("s", 9).desc(), "e"))).where(F.col("k") <= NEIGHBOURS)
    best = top.groupBy("q", "category").agg(F.sum("s").alias("w"), F.count(F.lit(1)).alias("n_alike"), F.min(F.struct("k", "e", "s")).alias("first"))
    own = Window.partitionBy("q")
    best = best.withColumn("all", F.sum("w").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.round("w", 9).desc(), "category")))
    out = best.where((F.col("r") == 1) & (F.col("w") >= AGREED * F.col("all")))
    out = out.select(F.col("q").alias("rep"), "category", "n_alike", F.col("first.e").alias("example_id"), F.col("first.s").alias("similarity"))
    same = asked.select("id", "key", "money_in").join(queries.select(F.col("id").alias("rep"), "key", "money_in"), ["key", "money_in"])
    return same.join(out, "rep").select("id", "category", "n_alike", "example_id", "similarity")
