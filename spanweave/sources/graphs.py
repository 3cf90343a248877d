"""Pattern graphs as edge rows: parsing of small written-out grammars, and node and edge exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The three example graphs that users know, as parent -> patterns.
EXAMPLES: dict[int, dict[str, list[list[str]]]] = {
    1: {
        "ab": [["a", "b"]],
        "by": [["b", "y"]],
        "yz": [["y", "z"]],
        "xa": [["x", "a"]],
        "xab": [["x", "ab"], ["xa", "b"]],
        "xaby": [["xab", "y"], ["xa", "by"]],
        "xabyz": [["xaby", "z"], ["xab", "yz"]],
        "wxabyzabbyxabyz": [["w", "xabyz", "ab", "by", "xabyz"]],
    },
    2: {
        "ab": [["a", "b"]],
        "bc": [["b", "c"]],
        "ef": [["e", "f"]],
        "gh": [["g", "h"]],
        "cd": [["c", "d"]],
        "def": [["d", "ef"]],
        "cdef": [["c", "def"]],
        "efgh": [["ef", "gh"]],
        "ghi": [["gh", "i"]],
        "aba": [["ab", "a"]],
        "abc": [["ab", "c"], ["a", "bc"]],
        "bcd": [["bc", "d"], ["b", "cd"]],
        "abcd": [["abc", "d"], ["a", "bcd"]],
        "efghi": [["efgh", "i"], ["ef", "ghi"]],
        "abab": [["aba", "b"], ["ab", "ab"]],
        "ababab": [["abab", "ab"], ["ab", "abab"]],
        "abcdefghi": [["abcd", "efghi"], ["ab", "cdef", "ghi"]],
        "ababcd": [["ab", "abcd"], ["aba", "bcd"], ["abab", "cd"]],
        "ababababcd": [["ababab", "abcd"], ["abab", "ababcd"], ["ab", "ababab", "cd"]],
        "ababcdefghi": [["ab", "abcdefghi"], ["ababcd", "efghi"]],
        "ababababcdefghi": [["ababababcd", "efghi"], ["abab", "ababcdefghi"], ["ababab", "abcdefghi"]],
    },
    3: {
        " mach": [[" ", "m", "a", "c", "h"]],
        "en": [["e", "n"]],
        " macht": [[" mach", "t"]],
        "t ": [["t", " "]],
        " machen": [[" mach", "en"]],
        "e mach": [["e", " mach"]],
        " macht ": [[" macht", " "], [" mach", "t "]],
        "e macht ": [["e mach", "t "], ["e", " macht "]],
        "e machen": [["e mach", "en"], ["e", " machen"]],
        "die": [["d", "i", "e"]],
        "hund": [["h", "u", "n", "d"]],
        "wuff": [["w", "u", "f", "f"]],
        "die ": [["die", " "]],
        " wuff": [[" ", "wuff"]],
        " hund": [[" ", "hund"]],
        " macht wuff": [[" macht ", "wuff"], [" macht", " wuff"]],
        "die hund": [["die", " hund"], ["die ", "hund"]],
        "die katze macht miau": [["die ", "k", "a", "t", "z", "e macht ", "m", "i", "a", "u"]],
        "der hund macht wuff": [["d", "e", "r", " hund", " macht wuff"]],
        "die hunde machen wuff": [["die hund", "e machen", " wuff"]],
    },
}

EDGE = "parent string, pattern_id int, sub_index int, offset int, child string, child_n int"


def pattern_graph(spark: SparkSession, rules: dict[str, list[list[str]]]) -> DataFrame:
    """partition_edge rows of a grammar given as parent -> patterns; every pattern must spell its parent."""
    rows = []
    for parent, patterns in rules.items():
        for p, cells in enumerate(patterns):
            if "".join(cells) != parent:
                raise ValueError(f"pattern {cells} does not spell {parent!r}")
            at = 0
            for i, c in enumerate(cells):
                rows.append((parent, p, i, at, c, len(c)))
                at += len(c)
    return spark.createDataFrame(rows, EDGE)


def from_table(rules: DataFrame) -> DataFrame:
    """rules(parent, pattern_id, cells array<string>) -> partition_edge rows: a grammar of any size from a table. A pattern that does
    not spell its parent is an error where it is read; a null parent or null cells are left out, and so are empty cells."""
    cells = F.filter("cells", lambda c: F.length(c) > 0)
    d = rules.filter("parent IS NOT NULL AND cells IS NOT NULL").select("parent", F.col("pattern_id").cast("int").alias("pattern_id"), cells.alias("cells"))
    spells = F.array_join("cells", "") == F.col("parent")
    d = d.withColumn("cells", F.when(spells, F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("a pattern does not spell "), F.col("parent")))))
    before = lambda i: F.aggregate(F.slice("cells", 1, i), F.lit(0), lambda n, c: n + F.length(c))
    each = F.transform("cells", lambda c, i: F.struct(i.alias("sub_index"), before(i).alias("offset"), c.alias("child"), F.length(c).alias("child_n")))
    return d.select("parent", "pattern_id", F.explode(each).alias("x")).select("parent", "pattern_id", "x.*")


def example(spark: SparkSession, number: int) -> DataFrame:
    return pattern_graph(spark, EXAMPLES[number])


def utf8_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, invalid): how many lines of each text file under the path are not UTF-8. Lines are checked where they are
    read, so a file of any size is dealt over tasks; no character of UTF-8 crosses a line's end."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.col("valid")).alias("invalid"))


def nodes_and_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (node, n) and distinct (parent, child) pairs of an edge table."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct().select("node", F.length("node").alias("n"))
    return nodes, edges.select("parent", "child").distinct()
