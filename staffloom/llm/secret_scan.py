"""Secret scans: a wide pattern finds candidates, a random forest removes false positives.

A candidate is a run of at least ``LEAST`` characters of letters, digits and ``+/_=-`` inside a word.  The forest judges
its length, shares and transitions of character classes, the share of its letter triples that stand in frequent
words of the corpus (the dictionary), the path it was found in, and the words beside it.  It is trained from labelled
findings; where a corpus has none, :func:`assigned` labels the findings that are assigned to a credential's name.

Everything is DataFrame functions and Spark's own forest; no Python runs in tasks.  The dictionary counts words of
all documents and has at most 26**3 triples, so it may be broadcast.  The forest is fitted on at most ``sample_rows``
labelled findings, chosen by hash.

Defined results: null or empty texts have no candidates; a null path is empty; repeated rows are reported each;
without labels of both kinds every candidate gets the one label's probability (0.5 without any), as it can't be judged.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffloom.llm.common import WORD, columns_of, stored

LEAST = 16
CORE = r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{16,}+"
NAMES = r"(?i)token|secret|passw|api_?key|access_?key|private_?key|credential|bearer"
FREQUENT = 5
SAMPLE_ROWS = 20_000
TREES, DEPTH = 20, 6


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, path, word_no, finding, word`` and the two words before (``before, second``) and one after (``after``)."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    beside = lambda at: F.coalesce(F.get("words", at), F.lit(""))
    found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(CORE))
    rows = columns_of(docs, doc_id="long", text="string", source="string").where(F.col("text").rlike(CORE))
    return (
        rows.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), words.alias("words"))
        .select("doc_id", "path", F.explode(F.transform(found, lambda i: F.struct(
            i.alias("word_no"), F.get("words", i).alias("word"), beside(i - 1).alias("before"), beside(i - 2).alias("second"), beside(i + 1).alias("after")
        ))).alias("c"))
        .select("doc_id", "path", "c.*").withColumn("finding", F.explode(F.regexp_extract_all("word", F.lit(f"({CORE})"), 1)))
    )


def dictionary(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Letter triples (``triple``) of the words that stand in at least ``frequent`` documents."""
    words = F.array_distinct(F.split(F.lower(F.col("`text`").cast("string")), "[^a-z]+"))
    common = docs.select(F.explode(words).alias("w")).where("length(w) between 3 and 15").groupBy("w").count().where(F.col("count") >= frequent)
    return common.select(F.explode(triples(F.col("w"))).alias("triple")).distinct()


def triples(text: Column) -> Column:
    """Triples of characters of a text of at least three."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))


def coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """``finding, covered``: share of its triples that are in the dictionary."""
    own = found.select("finding").distinct().select("finding", F.explode(triples(F.lower("finding"))).alias("triple"))
    hits = own.join(F.broadcast(known.withColumn("known", F.lit(1.0))), "triple", "left")
    return hits.groupBy("finding").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("covered"))


def features(found: DataFrame, known: DataFrame) -> tuple[DataFrame, list[str]]:
    """``found`` with the forest's figures, and their names."""
    n = F.length("finding")
    share = lambda pattern: F.regexp_count("finding", F.lit(pattern)) / n
    says = lambda c, pattern: F.col(c).rlike(pattern).cast("double")
    figures = {
        "f_length": n.cast("double"),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_lower": share("[a-z]"),
        "f_vowels": share("(?i)[aeiou]"),
        "f_hex": share("(?i)[0-9a-f]"),
        "f_digit_letter": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        "f_case": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "f_clusters": share("(?i)(?=[bcdfghjklmnpqrstvwxz]{3})"),
        "f_distinct": F.size(F.array_distinct(F.split("finding", ""))) / n,
        "f_path_test": says("path", "(?i)test|example|sample|doc|mock"),
        "f_path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "f_path_place": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double"),
        "f_quoted": says("word", "^[\"'`]"),
        "f_assigned": F.greatest(says("before", "[=:]$"), says("word", "^[A-Za-z_]+[=:]")),
        "f_named": F.greatest(says("before", NAMES), says("second", NAMES), says("word", NAMES)),
        "f_before_length": F.length("before").cast("double"),
        "f_after_digits": says("after", "[0-9]"),
        "f_before_digits": says("before", "[0-9]"),
        "f_covered": F.coalesce("covered", F.lit(0.0)),
    }
    return found.join(coverage(found, known), "finding", "left").withColumns(figures).drop("covered"), list(figures)


def assigned() -> Column:
    """Label of a finding by its place: 1 where it is the value assigned to a credential's name."""
    return ((F.col("second").rlike(NAMES) & F.col("before").rlike("[=:]$")) | F.col("word").rlike(f"({NAMES})[\"']?[=:]")).cast("int")


def judge(found: DataFrame, labelled: DataFrame, names: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``found`` with the forest's ``probability``; ``labelled`` has the same figures and ``label`` (0 or 1)."""
    collect = VectorAssembler(inputCols=names, outputCol="figures")
    sample = (
        labelled.where("label is not null").orderBy(F.xxhash64("finding", "doc_id", "word_no"), "finding", "doc_id", "word_no").limit(sample_rows)
        .select(F.col("label").cast("double").alias("label"), *names)
    )
    ready = collect.transform(sample).select("label", "figures").persist()
    try:
        kinds = [r.label for r in ready.groupBy("label").count().collect()]
        if len(kinds) < 2:
            return found.withColumn("probability", F.lit(kinds[0] if kinds else 0.5))
        forest = RandomForestClassifier(labelCol="label", featuresCol="figures", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(ready)
    finally:
        ready.unpersist()
    return forest.transform(collect.transform(found)).withColumn("probability", vector_to_array("probability")[1])


def scan(docs: DataFrame, labelled_rows: Column, least: float = 0.5) -> DataFrame:
    """``doc_id, word_no, finding, probability, is_secret`` of every candidate.

    The forest learns from candidates of the rows where ``labelled_rows`` holds (a condition on doc_id).
    """
    found, names = features(candidates(docs), dictionary(docs))
    found = stored(found, "findings")
    rated = judge(found, found.where(labelled_rows).withColumn("label", assigned()), names)
    return rated.select("doc_id", "word_no", "finding", "probability", (F.col("probability") >= least).alias("is_secret"))
