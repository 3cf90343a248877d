"""N-grams of characters or tokens: enumeration with positions, counts, and counts of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Start positions a chunk, in two rounds of cutting: substring() walks from the start of what it cuts.
CHUNKS = (8192, 64)
TOKEN_CHUNK = 256


def _cut(size: int, max_n: int):
    """A piece of `size` start positions from b on, with the character before it and the max_n characters after it."""
    return lambda b: F.struct(
        (F.col("base") + b).alias("base"), F.least(F.col("lead") + b, F.lit(1)).alias("lead"), F.least(F.lit(size), F.col("starts") - b).alias("starts"),
        F.substring(F.col("text"), F.greatest(F.col("lead") + b, F.lit(1)), F.lit(size + max_n + 1)).alias("text"),
    )


def occurrences(corpus: DataFrame, max_n: int | None = None, min_n: int = 1, ngrams_only: bool = False) -> DataFrame:
    """occurrence(text_id, pos, n, ngram, prev, next): every substring of min_n to max_n characters (all, if None).

    prev and next are the neighbouring characters, null at the text's ends; ngrams_only leaves just the ngram. With max_n, texts are cut into chunks of start
    positions with the characters they need, so a row of any length is expanded in pieces and never carried whole; without
    it the expansion is quadratic in the text's length.
    """
    d = corpus.filter(F.length("text") > 0)
    if max_n is None:
        d = d.select("text_id", F.lit(0).alias("base"), F.lit(0).alias("lead"), F.length("text").alias("starts"), F.length("text").alias("len"), "text")
    else:
        d = d.select("text_id", F.lit(0).alias("base"), F.lit(0).alias("lead"), F.length("text").alias("starts"), "text")
        for size in CHUNKS:
            d = d.select("text_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("starts") - 1, F.lit(size)), _cut(size, max_n))).alias("x")).select("text_id", "x.*")
        d = d.withColumn("len", F.length("text") - F.col("lead"))
    most = F.col("len") if max_n is None else F.least(F.lit(max_n), F.col("len"))
    sub = lambda at, n: F.substring(F.col("text"), at, n)
    one = lambda p, n: sub(F.col("lead") + p + 1, n) if ngrams_only else F.struct(
        (F.col("base") + p).alias("pos"), n.alias("n"), sub(F.col("lead") + p + 1, n).alias("ngram"),
        F.when(F.col("lead") + p > 0, sub(F.col("lead") + p, F.lit(1))).alias("prev"), F.when(p + n < F.col("len"), sub(F.col("lead") + p + n + 1, F.lit(1))).alias("next"),
    )
    places = lambda n: F.transform(F.sequence(F.lit(0), F.least(F.col("starts"), F.col("len") - n + 1) - 1), lambda p: one(p, n))
    d = d.withColumn("most", most).filter(F.col("most") >= min_n)
    every = F.flatten(F.transform(F.sequence(F.lit(min_n), F.col("most")), places))
    if ngrams_only:
        return d.select(F.explode(every).alias("ngram"))
    return d.select("text_id", F.explode(every).alias("o")).select("text_id", "o.*")


def counts(corpus: DataFrame, max_n: int | None = None, min_n: int = 1) -> DataFrame:
    """ngram, n, cnt. Occurrences are aggregated where they are made and carry nothing else.

    With max_n, each position yields its widest n-gram alone; narrower ones are prefixes of those, so they are summed over
    the distinct ones, which are far fewer than the positions.
    """
    if max_n is None:
        return occurrences(corpus, max_n, min_n, ngrams_only=True).groupBy("ngram").agg(F.count("*").alias("cnt")).select("ngram", F.length("ngram").alias("n"), "cnt")
    widest = _widest(corpus, max_n).groupBy("ngram").agg(F.count("*").alias("cnt")).filter(F.length("ngram") >= min_n)
    each = widest.select("cnt", F.explode(F.transform(F.sequence(F.lit(min_n), F.length("ngram")), lambda n: F.substring("ngram", F.lit(1), n))).alias("ngram"))
    return each.groupBy("ngram").agg(F.sum("cnt").alias("cnt")).select("ngram", F.length("ngram").alias("n"), "cnt")


def _widest(corpus: DataFrame, max_n: int) -> DataFrame:
    """(ngram): the widest n-gram of at most max_n characters that starts at each position of a corpus."""
    d = corpus.filter(F.length("text") > 0).select(F.lit(0).alias("base"), F.lit(0).alias("lead"), F.length("text").alias("starts"), "text")
    for size in CHUNKS:
        d = d.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("starts") - 1, F.lit(size)), _cut(size, max_n))).alias("x")).select("x.*")
    grams = F.transform(F.sequence(F.lit(1), F.col("starts")), lambda p: F.substring(F.col("text"), F.col("lead") + p, F.lit(max_n)))
    return d.select(F.explode(grams).alias("ngram"))


def token_counts(tokens: DataFrame, max_n: int, column: str = "tokens", between: str | None = None) -> DataFrame:
    """gram (array<string>), n, cnt of token arrays: keys are arrays, so tokens may hold any character.

    As in counts(), each position yields its widest gram alone, and narrower ones are summed over the distinct ones. With `between`,
    a string that no token holds, grams are tokens joined by it, null tokens left out: keys are small, and as most wide grams of
    words are distinct, each position yields all its grams, for one exchange in place of two.
    """
    if between is not None:
        w = F.array_compact(column) if tokens.schema[column].dataType.containsNull else F.col(column)
        names = [f"t{k}" for k in range(max_n)]
        d = tokens.select(w.alias("w")).select(F.inline(F.arrays_zip(*[F.slice("w", k + 1, F.size("w")) for k in range(max_n)])).alias(*names))
        grams = [F.when(F.col(names[k]).isNotNull(), F.concat_ws(between, *names[: k + 1])) for k in range(max_n)]
        d = d.select(F.explode(F.array(*grams)).alias("gram")).filter("gram IS NOT NULL").groupBy("gram").agg(F.count("*").alias("cnt"))
        n = F.length("gram") - F.length(F.replace("gram", F.lit(between), F.lit("")))
        return d.select("gram", (n / len(between) + 1).cast("int").alias("n"), "cnt")
    d = tokens.select(F.col(column).alias("w")).filter(F.size("w") > 0)
    # pieces of start positions with the tokens they need, so no row carries a whole text for each of its positions
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(TOKEN_CHUNK))
    d = d.select(F.explode(F.transform(starts, lambda p: F.struct(F.least(F.lit(TOKEN_CHUNK), F.size("w") - p + 1).alias("starts"), F.slice("w", p, TOKEN_CHUNK + max_n - 1).alias("w")))).alias("x")).select("x.*")
    d = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("starts")), lambda p: F.slice("w", p, max_n))).alias("gram"))
    d = d.groupBy("gram").agg(F.count("*").alias("cnt"))
    each = d.select("cnt", F.explode(F.transform(F.sequence(F.lit(1), F.size("gram")), lambda n: F.slice("gram", 1, n))).alias("gram"))
    return each.groupBy("gram").agg(F.sum("cnt").alias("cnt")).select("gram", F.size("gram").alias("n"), "cnt")


def repeated(counted: DataFrame) -> DataFrame:
    return counted.filter("cnt > 1")


def most_frequent_first(counted: DataFrame) -> DataFrame:
    return counted.orderBy(F.desc("cnt"), "ngram")


def histogram(counted: DataFrame) -> DataFrame:
    """cnt, ngrams: how many n-grams have each count."""
    return counted.groupBy("cnt").agg(F.count("*").alias("ngrams"))


def within_level(counted: DataFrame, p: str = "p") -> DataFrame:
    """Each n-gram's share of all occurrences of its width. The totals are one row a width, joined back."""
    totals = counted.groupBy("n").agg(F.sum("cnt").alias("total"))
    return counted.join(totals, "n").select("ngram", "n", "cnt", "total", (F.col("cnt") / F.col("total")).alias(p))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def running_offset(edges: DataFrame) -> DataFrame:
    """Pattern cells with their offset, as the sum of the widths before them."""
    w = Window.partitionBy("parent", "pattern_id").orderBy("sub_index").rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("offset", F.coalesce(F.sum("child_n").over(w), F.lit(0)).cast("int"))


def postings(corpus: DataFrame, max_n: int | None = None, block_texts: int = 4096) -> DataFrame:
    """ngram, block, cnt, texts, at: an inverted index. A block covers block_texts consecutive text ids, so an n-gram of every text
    is as many rows as there are blocks, and no row grows with the corpus.

    texts and at hold each occurrence in order: the text id less that of the occurrence before it (of the block's first id,
    at the beginning), and the position, less that before it where both are in one text.
    """
    begin = F.floor(F.col("text_id") / block_texts) * block_texts
    o = occurrences(corpus, max_n).select("ngram", F.floor(F.col("text_id") / block_texts).alias("block"), F.struct((F.col("text_id") - begin).cast("int").alias("t"), "pos").alias("x"))
    d = o.groupBy("ngram", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    last = lambda i: F.get("xs", i - 1)
    texts = F.transform("xs", lambda x, i: x["t"] - F.coalesce(last(i)["t"], F.lit(0)))
    at = F.transform("xs", lambda x, i: x["pos"] - F.when(last(i)["t"] == x["t"], last(i)["pos"]).otherwise(0))
    return d.select("ngram", "block", F.size("xs").cast("long").alias("cnt"), texts.alias("texts"), at.alias("at"))


def located(index: DataFrame, ngrams: DataFrame, block_texts: int = 4096) -> DataFrame:
    """ngrams(ngram) -> (ngram, text_id, pos): where they occur, read from postings()."""
    step = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("p"), F.array().cast("array<struct<t:bigint,p:int>>").alias("out"))

    def add(s, x):
        t = s["t"] + x["texts"]
        p = F.when((x["texts"] == 0) & (F.size(s["out"]) > 0), s["p"]).otherwise(0) + x["at"]
        return F.struct(t.alias("t"), p.alias("p"), F.concat(s["out"], F.array(F.struct(t.alias("t"), p.alias("p")))).alias("out"))

    hit = index.join(ngrams.select("ngram").distinct(), "ngram", "left_semi")
    hit = hit.select("ngram", "block", F.explode(F.aggregate(F.arrays_zip("texts", "at"), step, add, lambda s: s["out"])).alias("x"))
    return hit.select("ngram", (F.col("block") * block_texts + F.col("x.t")).alias("text_id"), F.col("x.p").alias("pos"))
