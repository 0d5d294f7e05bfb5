"""Keyword index: postings, field statistics, BM25 over filename, path and content, and the commit of index changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bound, words

#: Weight of each field (fixed values).
BOOSTS = {"filename": 2.0, "path": 1.0, "content": 1.0}
K1, B = 1.2, 0.75


def tokens(docs: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """(file_id, <field>: words of the field)."""
    return docs.select("file_id", *[words(F.col(f)).alias(f) for f in fields])


def postings(docs: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """(term, field, file_id, tf): the inverted index."""
    return index_rows(docs, fields).drop("len")


def index_rows(docs: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """(term, field, file_id, tf, len): the inverted index, with the number of words of the field. Terms are counted per document before anything is shuffled by term."""
    t = tokens(docs, fields)
    each = reduce(DataFrame.unionByName, [t.select("file_id", F.lit(f).alias("field"), F.size(f).alias("len"), F.explode(f).alias("term")) for f in fields])
    return each.groupBy("term", "field", "file_id", "len").agg(F.count("*").cast("int").alias("tf")).select("term", "field", "file_id", "tf", "len")


#: Partitions of a stored index by a hash of the term.
BUCKETS = 64


def laid_out(index: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Postings as they are stored: with ``bucket``, to be the partition column, and sorted by term, so that a query opens the buckets and row groups of its terms.

    Rows are dealt out by ranges of (bucket, term, file), so a term that a third of all documents hold fills many tasks.
    """
    return index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartitionByRange("bucket", "term", "file_id").sortWithinPartitions("bucket", "term", "file_id")


def lookup(stored: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The stored postings of some terms; the buckets are named in the plan, so that no other is read."""
    if not terms:
        return stored.where(F.lit(False))
    spark = stored.sparkSession
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()
    return stored.where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms))


def scores(stored: DataFrame, stats: dict[str, tuple[int, int]], query: list[str], boosts: dict[str, float] | None = None, keep: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(file_id, score): what ``bm25`` gives, read from a stored index.

    stats: by field the number of documents and of words in all of them, see ``field_stats``. ``keep`` has the file_ids that may be hits.
    One pass over the postings of the query's terms for their frequencies, and one that adds up each document's score.
    """
    boosts = BOOSTS if boosts is None else boosts
    own = lookup(stored, list(dict.fromkeys(query)), buckets).where(F.col("field").isin(list(boosts)))
    df = {(r["field"], r["term"]): r["count"] for r in own.groupBy("field", "term").count().collect()}  # a row for each field and term asked for
    part = F.lit(0.0)
    for (field, term), n in df.items():
        docs, words_ = stats[field]
        idf = F.log(1 + (F.lit(docs) - n + 0.5) / (F.lit(n) + 0.5))
        tf, mean = F.col("tf"), max(words_ / docs if docs else 0.0, 1e-9)
        part = F.when((F.col("field") == field) & (F.col("term") == term), F.lit(boosts[field]) * (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean))))).otherwise(part)
    if keep is not None:
        own = own.join(keep.select("file_id").distinct(), "file_id", "left_semi")
    return own.groupBy("file_id").agg(F.sum(part).alias("score"))


def field_stats(docs: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """(field, docs, terms): one row a field, from one pass."""
    t = tokens(docs, fields).agg(F.count("*").alias("docs"), *[F.sum(F.size(f)).alias(f) for f in fields])
    return t.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), "docs", F.coalesce(f, F.lit(0)).alias("terms")) for f in fields])).alias("s")).select("s.*")


def document_frequency(docs: DataFrame, field: str = "content") -> DataFrame:
    """(term, df, tf) of a field."""
    t = tokens(docs, (field,))
    per = t.select("file_id", F.explode(field).alias("term")).groupBy("term", "file_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def bm25(docs: DataFrame, query: list[str], boosts: dict[str, float] | None = None, keep: Column | None = None) -> DataFrame:
    """(file_id, score): boosted BM25 of the documents that hold any query word; terms are ORed.

    Statistics are those of all documents; ``keep`` filters what may be a hit. Two passes, without a shuffle of documents: one
    aggregation to a single row of statistics, read by the driver, then each document scores itself.
    """
    boosts = BOOSTS if boosts is None else boosts
    terms = list(dict.fromkeys(query))
    extra = [keep.alias("_keep")] if keep is not None else []
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    facts = lambda a: F.struct(F.size(a).alias("len"), F.array(*[count(a, w) for w in terms], F.lit(0)).alias("tf"))
    t = docs.select("file_id", *extra, *[bound(words(F.col(f)), facts).alias(f) for f in boosts])
    tf = {(f, i): F.col(f"{f}.tf")[i] for f in boosts for i in range(len(terms))}
    t = t.select("file_id", *(["_keep"] if extra else []), *[F.col(f"{f}.len").alias(f"len_{f}") for f in boosts], *[c.alias(f"tf_{f}_{i}") for (f, i), c in tf.items()])
    stats = t.agg(F.count("*").alias("_n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in boosts], *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f, i in tf])
    one = stats.first()
    fact = lambda name: F.lit(one[name])
    if not one["_n"]:
        return docs.limit(0).select("file_id", F.lit(0.0).alias("score"))
    score, any_hit = F.lit(0.0), F.lit(False)
    for f, boost in boosts.items():
        for i in range(len(terms)):
            n, df = F.col(f"tf_{f}_{i}"), fact(f"df_{f}_{i}")
            idf = F.log(1 + (fact("_n") - df + 0.5) / (df + 0.5))
            part = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col(f"len_{f}") / F.lit(max(one[f"avg_{f}"], 1e-9))))
            score = score + F.when(n > 0, F.lit(boost) * part).otherwise(0.0)
            any_hit = any_hit | (n > 0)
    hit = any_hit & F.coalesce("_keep", F.lit(False)) if extra else any_hit
    return t.where(hit).select("file_id", score.alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """(rank, file_id, score): the k best, ties by id; partial top-k in each task."""
    best = scored.select("file_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(k)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")))


def commit(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, generation, op, seq, receipt): a receipt for every mutation of a batch.

    stale unless its generation is the catalog's; of the fresh ones of a file the last (by seq, then op) is committed, the others are coalesced.
    """
    f = files.select("file_id", F.col("generation").alias("_g"))
    j = requests.join(f, "file_id", "left").withColumn("_fresh", F.coalesce(F.col("_g") == F.col("generation"), F.lit(False)))
    last = j.where("_fresh").groupBy("file_id").agg(F.max(F.struct("seq", "copy", "op")).alias("_l"))
    j = j.join(last, "file_id", "left")
    receipt = F.when(~F.col("_fresh"), "stale").when(F.struct("seq", "copy", "op") == F.col("_l"), "committed").otherwise("coalesced")
    return j.select("file_id", "generation", "op", "seq", "copy", receipt.alias("receipt"))


def apply_commit(index: DataFrame, docs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Postings after a commit: all old ones of the files concerned go, those of committed upserts come."""
    done = receipts.where("receipt = 'committed'")
    kept = index.join(done.select("file_id").distinct(), "file_id", "left_anti")
    new = docs.join(done.where("op = 'upsert'").select("file_id").distinct(), "file_id", "left_semi")
    return kept.select("term", "field", "file_id", "tf").unionByName(postings(new))
