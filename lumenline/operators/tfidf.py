"""TF-IDF in long form: a row for each document and term, never a dense matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, let
from ..sources.scratch import stored


def default_stop_words(spark) -> list[str]:
    """The English stop words that come with Spark."""
    return list(spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"))


def tokens(text, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of two characters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def with_bigrams(words: Column) -> Column:
    pairs = F.filter(F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.concat(w, F.lit(" "), F.get(words, i + 1)))), lambda x: x.isNotNull())
    return F.concat(words, pairs)


def tfidf_weights(docs: DataFrame, keys: tuple[str, ...], doc: str = "doc", text: str = "text", stop_words: list[str] | None = None, bigrams: bool = False, min_df: int = 1, sublinear: bool = False) -> DataFrame:
    """(keys, doc, term, weight): rows of unit length, with smoothed idf over all documents of a key.

    ``docs`` holds all that share an idf; documents without a term that is kept have no rows.
    """
    words = tokens(text, stop_words)
    # Bound to a variable: a text would be cut into words again for each pair.
    terms = let(words, with_bigrams) if bigrams else words
    counts = docs.select(*keys, doc, F.explode(terms).alias("term")).groupBy(*keys, doc, "term").agg(F.count("*").alias("tf"))
    if keys:
        total = docs.groupBy(*keys).agg(F.count("*").alias("__n"))
        counts = counts.join(total, list(keys))
    else:
        counts = counts.crossJoin(F.broadcast(docs.agg(F.count("*").alias("__n"))))  # one row
    # A common term has a row for every document: its count is summed before the shuffle, and the join can be split.
    seen = counts.groupBy(*keys, "term").agg(F.count("*").alias("__df")).where(F.col("__df") >= min_df)
    counts = counts.join(seen, [*keys, "term"])
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.withColumn("__w", tf * (F.log((1 + F.col("__n")) / (1 + F.col("__df"))) + 1))
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(*keys, doc)))
    return raw.select(*keys, doc, "term", (F.col("__w") / length).alias("weight"))


def cosine_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], a: str, b: str) -> DataFrame:
    """(keys, a, b, similarity) of the pairs that share a term."""
    pairs = left.select(*keys, F.col("doc").alias(a), "term", F.col("weight").alias("__x")).join(right.select(*keys, F.col("doc").alias(b), "term", F.col("weight").alias("__y")), [*keys, "term"])
    return pairs.groupBy(*keys, a, b).agg(F.sum(F.col("__x") * F.col("__y")).alias("similarity"))


def counted_terms(docs: DataFrame, doc: str) -> DataFrame:
    """(doc, terms): every document's distinct terms with their numbers, one row for each id; texts are sent once, words never."""
    own = docs.groupBy(doc).agg(F.collect_list("text").alias("__texts"))
    words = F.array_sort(F.flatten(F.transform("__texts", lambda x: tokens(x))))
    # Sorted, equal words are neighbours: counts are the distances between the places where a new one begins.
    places = lambda w: F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i == 0) | (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
    term = lambda w, p, i, at: F.when(at < F.size(p) - 1, F.struct(F.get(w, i).alias("term"), (F.get(p, at + 1) - i).cast("long").alias("tf")))
    found = let(words, lambda w: let(places(w), lambda p: F.filter(F.transform(p, lambda i, at: term(w, p, i, at)), lambda x: x.isNotNull())))
    return own.select(doc, found.alias("terms"))


def joint_similarity(left: DataFrame, right: DataFrame, a: str, b: str, common: int = 1 << 17) -> DataFrame:
    """(a, b, similarity) of documents (a, text) and (b, text) that share a term; idf is joint over both.

    Meant for few documents on the left: their terms meet the right ones' where these are, and only the texts of the right are sent.
    A vector's length needs the document frequencies of all its terms. Those of terms that are frequent, at most ``common``
    of them, are brought to the documents; only a document's other terms are sent to theirs.
    """
    total = left.select(F.lit(1)).union(right.select(F.lit(1))).agg(F.count("*").alias("__n"))
    l, r = counted_terms(left, a), counted_terms(right, b)
    each = lambda rows, doc: rows.select(doc, F.inline("terms"))
    seen = each(l, a).select("term").unionAll(each(r, b).select("term")).groupBy("term").agg(F.count("*").alias("__df"))
    # Stored, so that joins know its size; it is used four times.
    seen = stored(seen, "document-frequencies")
    idf = seen.crossJoin(F.broadcast(total)).select("term", "__df", (F.log((1 + F.col("__n")) / (1 + F.col("__df"))) + 1).alias("__idf"))
    least = seen.agg((F.sum("__df") / common).alias("__least"))
    frequent = idf.crossJoin(F.broadcast(least)).where(F.col("__df") >= F.col("__least")).select("term", "__idf")
    frequent = F.broadcast(stored(frequent, "frequent-terms"))
    square = F.sum((F.col("tf") * F.col("__idf")) * (F.col("tf") * F.col("__idf"))).alias("__square")

    def squares(rows: DataFrame, doc: str) -> DataFrame:
        near = each(rows, doc).join(frequent, "term").groupBy(doc).agg(square)
        far = each(rows, doc).join(frequent, "term", "left_anti").join(idf, "term").groupBy(doc).agg(square)
        return near.unionAll(far).groupBy(doc).agg(F.sqrt(F.sum("__square")).alias("__length"))

    w = each(l, a).join(idf, "term").join(squares(l, a), a).select(a, "term", "__idf", (F.col("tf") * F.col("__idf") / F.col("__length")).alias("__x"))
    w = stored(w, "weights")
    dots = each(r, b).join(w, "term").groupBy(a, b).agg(F.sum(F.col("__x") * (F.col("tf") * F.col("__idf"))).alias("__dot"))
    return dots.join(squares(r, b).hint("shuffle_hash"), b).select(a, b, (F.col("__dot") / F.col("__length")).alias("similarity"))


def event_slide_similarity(events: DataFrame, slides: DataFrame, stop_words: list[str] | None, keys: tuple[str, ...] = ("lecture_id",)) -> DataFrame:
    """(keys, event_index, slide_number, similarity) of every event and slide of a lecture; idf is joint over both."""
    e = events.select(*keys, F.lit("e").alias("__side"), F.col("event_index").cast("long").alias("__id"), F.col("ocr_text").alias("text"))
    s = slides.select(*keys, F.lit("s").alias("__side"), F.col("slide_number").cast("long").alias("__id"), F.col("reference_text").alias("text"))
    docs = e.unionByName(s).withColumn("doc", F.struct("__side", "__id"))
    weights = tfidf_weights(docs, keys, stop_words=stop_words, bigrams=True)
    side = lambda x: weights.where(F.col("doc.__side") == x).withColumn("doc", F.col("doc.__id"))
    found = cosine_join(side("e"), side("s"), keys, "event_index", "slide_number")
    cells = events.select(*keys, F.col("event_index").cast("long").alias("event_index")).join(slides.select(*keys, F.col("slide_number").cast("long").alias("slide_number")), list(keys))
    return cells.join(found, [*keys, "event_index", "slide_number"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def consecutive_similarity(weights: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("lecture_id",), doc: str = "doc") -> DataFrame:
    """``frames`` with the cosine of each with the one before; null for the first, 0 where they share no term."""
    w = Window.partitionBy(*keys).orderBy(doc)
    order = frames.withColumn("__before", F.lag(doc).over(w))
    pairs = order.select(*keys, doc, "__before").where("__before is not null")
    now = pairs.join(weights.withColumnsRenamed({"weight": "__x"}), [*keys, doc])
    before = weights.select(*keys, F.col(doc).alias("__before"), "term", F.col("weight").alias("__y"))
    found = now.join(before, [*keys, "__before", "term"]).groupBy(*keys, doc).agg(F.sum(F.col("__x") * F.col("__y")).alias("similarity"))
    joined = order.join(found, [*keys, doc], "left")
    return joined.withColumn("similarity", F.when(F.col("__before").isNotNull(), F.coalesce("similarity", F.lit(0.0)))).drop("__before")


def segment_keywords(weights: DataFrame, members: DataFrame, count: int = 8, keys: tuple[str, ...] = ("lecture_id",), segment: str = "segment_idx", doc: str = "doc") -> DataFrame:
    """(keys, segment, place, term, weight): each segment's terms of the largest mean weight; ties by falling term."""
    frames = members.groupBy(*keys, segment).agg(F.count("*").alias("__n"))
    sums = weights.join(members.select(*keys, doc, segment), [*keys, doc]).groupBy(*keys, segment, "term").agg(F.sum("weight").alias("__w"))
    mean = sums.join(frames, [*keys, segment]).withColumn("weight", F.round(F.col("__w") / F.col("__n"), 9))
    best = Window.partitionBy(*keys, segment).orderBy(F.desc("weight"), F.desc("term"))
    return mean.withColumn("place", F.row_number().over(best)).where((F.col("place") <= count) & (F.col("weight") > 0)).select(*keys, segment, "place", "term", "weight")
