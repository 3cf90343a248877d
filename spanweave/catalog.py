"""The registered queries: each applies operators to whole tables. Their SQL is in catalog_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_sql import SQL
from .functions import ngrams, text, tokens
from .operators import containment, cover, labels, language_model, partition, search, whole
from .plans.parse import parse_corpus
from .plans.tables import settle
from .sources import corpus as corpora
from .sources import graphs
from .streaming.incremental import StreamingCounts, StreamingLabels


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct part names as a corpus."""
    return corpora.from_column(_table(spark, sf, "part"), "p_name")


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct part types, in lower case, as queries."""
    return _table(spark, sf, "part").filter(F.length("p_type") > 0).select(F.lower("p_type").alias("query")).distinct()


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.from_column(_table(spark, sf, "documents"), "text", "doc_id")


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return containment.vocabulary(_names(spark, sf))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    vocab = settle(_vocab(spark, sf), "vocab")
    return settle(labels.all_labels(_names(spark, sf), vocab), "labels")


def _grammar(spark: SparkSession, sf: str) -> DataFrame:
    return settle(partition.partition_static(_labels(spark, sf)), "grammar")


def _six(column: str):
    return F.round(F.col(column), 6).alias(column)


def ngram_occurrences(spark, sf):
    return ngrams.occurrences(_names(spark, sf)).select("text_id", "pos", "n", "ngram")


def occurrence_context(spark, sf):
    o = ngrams.occurrences(_names(spark, sf))
    return o.select("text_id", "pos", "n", "ngram", "prev", "next")


def ngram_counts_all(spark, sf):
    return ngrams.counts(_names(spark, sf))


def ngram_counts_bounded9(spark, sf):
    return ngrams.counts(_names(spark, sf), 9)


def document_ngram_counts(spark, sf):
    return ngrams.counts(_documents(spark, sf), 3)


def repeated_ngrams(spark, sf):
    return ngrams.repeated(ngrams.counts(_names(spark, sf)))


def count_histogram(spark, sf):
    return ngrams.histogram(ngrams.counts(_names(spark, sf)))


def corpus_statistics(spark, sf):
    c = _documents(spark, sf)
    return c.agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"), F.max(F.length("text")).cast("long").alias("longest"), F.max(text.byte_length(F.col("text"))).cast("long").alias("longest_bytes"))


def vocab_roots_leaves(spark, sf):
    return _vocab(spark, sf).select("ngram", "n", "cnt", "is_root", "is_leaf")


def first_seen_roots(spark, sf):
    return _vocab(spark, sf).filter("first_root").select("ngram", "n")


def containment_edges(spark, sf):
    return containment.edges(_vocab(spark, sf))


def bottom_up_neighbours(spark, sf):
    return containment.bottom_up(containment.edges(_vocab(spark, sf)))


def node_degree(spark, sf):
    return containment.degrees(containment.edges(_vocab(spark, sf)))


def nodes_by_width(spark, sf):
    return containment.by_width(_vocab(spark, sf))


def edge_offsets(spark, sf):
    e = containment.edge_offsets(containment.edges(_vocab(spark, sf)))
    return e.select("parent", "child", F.array_join(e["offsets"].cast("array<string>"), ",").alias("offsets"))


def frequency_labels(spark, sf):
    return labels.frequency_labels(_vocab(spark, sf))


def wrapper_labels(spark, sf):
    vocab = settle(_vocab(spark, sf), "vocab")
    return labels.wrapper_labels(_names(spark, sf), labels.base_labels(vocab))


def all_labels(spark, sf):
    return _labels(spark, sf)


def child_cover(spark, sf):
    return cover.child_cover(_labels(spark, sf))


def cover_overlaps(spark, sf):
    return cover.overlaps(settle(cover.child_cover(_labels(spark, sf)), "cover"))


def cover_hull(spark, sf):
    return cover.hull(cover.child_cover(_labels(spark, sf)))


def partition_static(spark, sf):
    return partition.partition_static(_labels(spark, sf))


def partition_graph(spark, sf):
    return partition.partition_graph(_labels(spark, sf))[0]


def partition_offsets(spark, sf):
    return ngrams.running_offset(_grammar(spark, sf).drop("offset")).select("parent", "pattern_id", "sub_index", "offset", "child")


def partition_cells(spark, sf):
    g = _grammar(spark, sf)
    return g.select("parent", "pattern_id", "sub_index", text.cell(F.col("child")).alias("cell"))


def digrams(spark, sf):
    return partition.digram_report(_grammar(spark, sf))


def pattern_splits(spark, sf):
    """Every label split in its middle: the cells that the position falls into."""
    g = _grammar(spark, sf)
    middles = g.select("parent").distinct().select("parent", F.floor(F.length("parent") / 2).cast("int").alias("at"))
    return partition.split_at(g, middles)


def completed_splits(spark, sf):
    """All splits that follow when each part name is split after a third and two thirds of it."""
    n = F.length("text")
    thirds = F.array(F.floor(n / 3), F.floor(2 * n / 3))
    asked = _names(spark, sf).select(F.col("text").alias("parent"), F.explode(thirds).alias("at")).filter("at > 0")
    return partition.completed(_grammar(spark, sf), asked)


def joined_partitions(spark, sf):
    """What has to be joined in every label that is split in its middle: its children's ends are the inner splits."""
    g = _grammar(spark, sf)
    middle = F.floor(F.length("parent") / 2).cast("int")
    inner = g.filter("offset > 0").select("parent", F.col("offset").alias("at"), F.lit(False).alias("top"))
    return partition.joined_partitions(inner.union(g.select("parent", middle, F.lit(True)).distinct()))


def joined_patterns(spark, sf):
    """The nodes and patterns that splitting every label in its middle brings about; see joined_partitions."""
    g = _grammar(spark, sf)
    middle = F.floor(F.length("parent") / 2).cast("int")
    inner = g.filter("offset > 0").select("parent", F.col("offset").alias("at"), F.lit(False).alias("top"))
    return partition.joined_patterns(g, inner.union(g.select("parent", middle, F.lit(True)).distinct()))


def read_sequences(spark, sf):
    """The part types read into the labels of the part names: each as known strings one after the other."""
    return search.read_sequences(_types(spark, sf), _labels(spark, sf))[0]


def document_labels(spark, sf):
    """Whole documents, their characters, and all that recurs in them without a fixed neighbour, of any width."""
    return whole.text_labels(_documents(spark, sf), seed=4)


def document_short_labels(spark, sf):
    """What recurs in whole documents without a fixed neighbour, in two to nine characters, with its counts."""
    return whole.repeated_closed(_documents(spark, sf), seed=4, widest=9)


def document_spelling(spark, sf):
    """Each document as its rule of recurring strings spells it."""
    rules = whole.labelled(_documents(spark, sf), seed=4)
    return whole.joined_cells(rules, "text_id").select(F.col("text_id").alias("doc_id"), F.md5(F.col("spelled").cast("binary")).alias("digest"))


def parsed_types(spark, sf):
    """The grammar of the part types, parsed with n-grams of at most four characters: every text has a rule that spells it."""
    corpus = _types(spark, sf).select(F.xxhash64("query").alias("text_id"), F.col("query").alias("text"))
    graph = parse_corpus(corpus, max_n=4).graph.join(corpus.select(F.col("text").alias("parent")), "parent", "left_semi")
    return whole.joined_cells(graph).select(F.col("parent").alias("text"), "spelled")


def wrapper_ranges(spark, sf):
    """Where chains of overlapping labelled intervals of the part names lead to."""
    names = _names(spark, sf)
    base = labels.base_labels(settle(_vocab(spark, sf), "vocab"))
    return labels.wrapper_ranges(labels.labelled_intervals(names, base))


def ngram_postings(spark, sf):
    d = ngrams.postings(_names(spark, sf), block_texts=16)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return d.select("ngram", "block", "cnt", joined("texts"), joined("at"))


def search_places(spark, sf):
    """Where the largest prefixes of the part types occur in the part names, from the postings."""
    names = settle(_names(spark, sf), "names")
    found = settle(search.largest_prefix(_types(spark, sf), containment.vocabulary(names)), "found")
    places = ngrams.located(ngrams.postings(names, block_texts=16), found.select(F.col("match").alias("ngram")), block_texts=16)
    return found.join(places, found["match"] == places["ngram"]).select("query", "match", "text_id", "pos")


def _event_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = corpora.sequences(_table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    symbols = tokens.alphabet(rows)
    return settle(tokens.encoded(rows, symbols), "sequences"), symbols


def event_labels(spark, sf):
    """Runs of events that recur without a fixed neighbour, in all users' sequences, and the sequences and events themselves."""
    corpus, symbols = _event_texts(spark, sf)
    return tokens.decoded(whole.text_labels(corpus, seed=3), symbols, "ngram").select(F.col("ngram").alias("gram"), "n", "kind")


def event_rules(spark, sf):
    """Each user's events as recurring runs one after the other, the longest from the left."""
    corpus, symbols = _event_texts(spark, sf)
    found = settle(whole.text_labels(corpus, seed=3).filter("kind <> 'root'"), "labels")
    rules = tokens.decoded(whole.tiled(corpus, found), symbols, "child")
    return rules.select(F.col("text_id").alias("user_id"), "sub_index", "offset", F.col("child").alias("gram"), F.col("child_n").alias("n"))


def word_labels(spark, sf):
    """Runs of words that recur in the documents without a fixed neighbour, of any length, with their counts."""
    d = _table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("text_id"), ngrams.words(F.col("text")).alias("tokens"))
    symbols = settle(tokens.numbers(d), "numbers")  # there may be more words than characters
    found = whole.located(settle(tokens.encoded(d, symbols), "words"), seed=2)
    return tokens.cut(found, d).select(F.md5(F.col("gram").cast("binary")).alias("gram"), "n", "cnt")


def reconstruct_texts(spark, sf):
    c = _names(spark, sf)
    return partition.reconstructed(_grammar(spark, sf), c.select("text"))


def grammar_nodes(spark, sf):
    return graphs.nodes_and_edges(_grammar(spark, sf))[0]


def grammar_edges(spark, sf):
    return graphs.nodes_and_edges(_grammar(spark, sf))[1]


def count_propagation(spark, sf):
    return containment.propagated_counts(_names(spark, sf), containment.edges(settle(_vocab(spark, sf), "vocab")))


def search_largest_prefix(spark, sf):
    return search.largest_prefix(_types(spark, sf), _vocab(spark, sf))


def search_root(spark, sf):
    known = settle(_labels(spark, sf), "labels")
    return search.search_root(search.largest_prefix(_types(spark, sf), _vocab(spark, sf)), known)


def search_trace(spark, sf):
    vocab = settle(_vocab(spark, sf), "vocab")
    found = search.search_root(search.largest_prefix(_types(spark, sf), vocab), _labels(spark, sf))
    return search.trace(settle(found, "found"))


def read_decomposition(spark, sf):
    return search.decomposition(_types(spark, sf), _labels(spark, sf))


def unknown_blocks(spark, sf):
    return search.blocks(_types(spark, sf), _vocab(spark, sf).filter("is_leaf"))


def insert_texts(spark, sf):
    """The labels of the part names after the part types were inserted."""
    return search.inserted(_names(spark, sf), _labels(spark, sf), _types(spark, sf).select(F.col("query").alias("text")))


def insert_grammar(spark, sf):
    """The grammar of the part names after the part types were inserted, from that of the names alone."""
    old = _labels(spark, sf)
    new = search.inserted(_names(spark, sf), old, _types(spark, sf).select(F.col("query").alias("text")))
    return partition.repartitioned(partition.partition_static(old), old, settle(new, "grown"))


def rule_union(spark, sf):
    """The grammar's patterns before those of the containment graph, for each label."""
    d = partition.rule_union(_grammar(spark, sf), containment.edges(_vocab(spark, sf)).join(_labels(spark, sf).select(F.col("ngram").alias("parent")), "parent", "left_semi"))
    return d.select("parent", F.array_join(d["bounds"].cast("array<string>"), ",").alias("bounds"), "given")


def example_graphs(spark, sf):
    one, two, three = (graphs.example(spark, k).withColumn("graph", F.lit(k)) for k in (1, 2, 3))
    return one.union(two).union(three)


def graph_of_names(spark, sf):
    """A grammar read from a table: each part name as its words and blanks, and as its first word with a blank before the rest."""
    names = _names(spark, sf).select(F.col("text").alias("parent"))
    words = names.select("parent", F.lit(0).alias("pattern_id"), F.expr("regexp_extract_all(parent, '[^ ]+| ', 0)").alias("cells"))
    at = F.instr("parent", " ")
    halves = names.filter((at > 1) & (at < F.length("parent"))).select("parent", F.lit(1), F.array(F.left("parent", at), F.substring("parent", at + 1, F.length("parent"))))
    return graphs.from_table(words.union(halves))


def vocab_widest_first(spark, sf):
    return containment.widest_first(_vocab(spark, sf)).select("ngram", "n", "cnt")


def most_frequent_ngrams(spark, sf):
    return ngrams.most_frequent_first(ngrams.counts(_names(spark, sf)))


def shared_ngrams(spark, sf):
    """The n-grams that part names and part types have in common, with their counts in the names."""
    return containment.shared(_vocab(spark, sf), containment.vocabulary(_types(spark, sf).select(F.xxhash64("query").alias("text_id"), F.col("query").alias("text")))).select("ngram", "n", "cnt")


def match_patterns(spark, sf):
    q = search.largest_prefix(_types(spark, sf), _vocab(spark, sf))
    m = search.match_patterns(F.col("query"), F.col("match"))
    return q.select("query", "match", m["kind"].alias("kind"), m["remainder"].alias("rest"))


def neighbourhood(spark, sf):
    return containment.neighbourhood(_grammar(spark, sf))


def cond_prob(spark, sf):
    d = language_model.conditional(settle(_vocab(spark, sf), "vocab"))
    return d.select("v", "x", _six("p"))


def prob_within_n(spark, sf):
    d = ngrams.within_level(settle(_vocab(spark, sf), "vocab"))
    return d.select("ngram", "n", _six("p"))


def next_token(spark, sf):
    return language_model.continuations(settle(_vocab(spark, sf), "vocab")).select("v", "w", _six("p"))


def most_likely_next(spark, sf):
    return language_model.most_likely(language_model.continuations(settle(_vocab(spark, sf), "vocab"))).select("v", "w", _six("p"))


def backoff(spark, sf):
    cont = settle(language_model.continuations(settle(_vocab(spark, sf), "vocab")), "next")
    return language_model.backoff(_types(spark, sf).select(F.col("query").alias("context")), cont).select("context", "used", "w", _six("p"))


def node_contexts(spark, sf):
    return language_model.contexts(_vocab(spark, sf), _labels(spark, sf))


def similarity(spark, sf):
    d = language_model.syntactic(language_model.siblings(_grammar(spark, sf)))
    return d.select("a", "b", _six("similarity"))


def semantic_distance(spark, sf):
    g = _grammar(spark, sf)
    return language_model.semantic_distance(language_model.siblings(g), g).select("a", "b", _six("distance"))


def word_ngrams(spark, sf):
    """Word n-grams (up to 2) that recur in the documents."""
    d = _table(spark, sf, "documents").filter("text IS NOT NULL").select(ngrams.words(F.col("text")).alias("tokens"))
    return ngrams.repeated(ngrams.token_counts(d, 2, between=" "))  # words hold no space


def event_ngrams(spark, sf):
    s = corpora.sequences(_table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return ngrams.token_counts(s, 3).select(F.array_join("gram", " ").alias("gram"), "n", "cnt")


def scalar_functions(spark, sf):
    p, t = F.col("text"), _names(spark, sf)
    return t.select(
        "text", text.byte_length(p).alias("bytes"), text.first_char(p).alias("first"), text.truncated(p, 8).alias("short"), text.encoded(p).alias("b64"),
        text.decoded(text.encoded(p)).alias("back"), F.size(text.characters(p)).alias("chars"), F.round(text.percent(F.length(p), F.lit(12)), 6).alias("percent"),
    )


def streaming_counts(spark, sf):
    schema = _table(spark, sf, "part").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").option("recursiveFileLookup", "false").parquet(sf)
    return StreamingCounts(spark).run(stream.select(F.col("p_name").alias("text")))


def streaming_labels(spark, sf):
    """Labels of a stream of part names that comes in five files, one a batch."""
    folder = settle(_names(spark, sf).select("text").repartition(5, "text"), "files").inputFiles()[0].rpartition("/")[0]
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(folder)
    kept = StreamingLabels(spark)
    kept.run(stream)
    return kept.labels()


_ALL = (
    ngram_occurrences, occurrence_context, ngram_counts_all, ngram_counts_bounded9, document_ngram_counts, repeated_ngrams, count_histogram, corpus_statistics,
    vocab_roots_leaves, first_seen_roots, containment_edges, bottom_up_neighbours, node_degree, nodes_by_width, edge_offsets, frequency_labels, wrapper_labels,
    all_labels, child_cover, cover_overlaps, cover_hull, partition_static, partition_graph, partition_offsets, partition_cells, digrams, pattern_splits, completed_splits, joined_partitions,
    reconstruct_texts, grammar_nodes, grammar_edges, count_propagation, search_largest_prefix, search_root, search_trace, read_decomposition, unknown_blocks,
    insert_texts, insert_grammar, rule_union, example_graphs, vocab_widest_first, most_frequent_ngrams, shared_ngrams, match_patterns, neighbourhood, cond_prob, prob_within_n, next_token, most_likely_next, backoff, node_contexts, similarity, semantic_distance,
    word_ngrams, event_ngrams, scalar_functions, streaming_counts, streaming_labels, joined_patterns, read_sequences, document_labels, document_short_labels, document_spelling,
    parsed_types, graph_of_names, wrapper_ranges, ngram_postings, search_places, event_labels, event_rules, word_labels,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
