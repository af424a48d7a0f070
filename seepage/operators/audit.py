"""Leak audit: candidate strings in samples, found verbatim in a corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.functions import patterns
from seepage.functions.text import LINE_BREAK
from seepage.functions.text import lines as split_lines
from seepage.operators import search
from seepage.operators.skew import lookup
from seepage.session import fits_broadcast, materialise

AUTOMATON_CHARS = 2_000_000  # characters of all terms up to which they are broadcast
NAME_WORDS = 8  # words of the longest reading of a name


def corpus_lines(corpus: DataFrame, column: str = "text") -> DataFrame:
    """Lower-cased lines of a corpus, one row each."""
    return corpus.select(F.explode(split_lines(F.lower(F.col(column)))).alias("line"))


def corpus_texts(corpus: DataFrame, column: str = "text") -> DataFrame:
    """Lower-cased whole texts: all that ``corpus_hits`` needs, which looks for no term over a line break."""
    return corpus.select(F.lower(F.col(column)).alias("line"))


def choose_corpus(sample_name: str, corpora: Mapping[str, DataFrame]) -> DataFrame:
    """The corpus whose key occurs in the name of the sample file."""
    for key, corpus in corpora.items():
        if key in sample_name.lower():
            return corpus
    raise ValueError(f"no corpus for sample file {sample_name!r}")


def _listed(words: DataFrame, names: DataFrame) -> DataFrame:
    """The rows whose ``_word`` is among the lower-cased ``name`` values."""
    listed = names.select(F.lower("name").alias("_word")).distinct()
    if fits_broadcast(listed):
        return words.join(F.broadcast(listed), "_word", "left_semi")
    weights = materialise(
        words.groupBy("_word")
        .agg(F.count("*").alias("_n"))
        .join(listed, "_word", "left_semi")
        .withColumn("_ok", F.lit(True)),
        "names",
    )
    total = weights.agg(F.sum("_n")).first()[0] or 0
    return lookup(words, weights, "_word", "_n", ["_ok"], total, "inner")


def name_matches(samples: DataFrame, names: DataFrame, key: str = "sample_id") -> DataFrame:
    """Possible names in runs of title-case words: (key, category, match, tail).

    A listed name, of one word or several, may be the start of a longer one, and its
    run may go on with words that aren't part of it. So every reading counts that
    begins with a listed name and ends at a word of the run, up to ``NAME_WORDS``
    words; ``tail`` is the longest reading from the same start. ``keep_found`` keeps
    the longest one that the corpus has. ``names`` has a ``name`` column.
    """
    listed = names.select(F.array_join(F.filter(F.split(F.lower("name"), " "), lambda w: w != ""), " ").alias("name")).filter("name <> ''")
    # the paths of a trie over words: a start matches while some name goes on
    deepest = listed.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    runs = samples.select(
        key, F.explode(F.array_distinct(patterns.find_name_runs(F.col("text")))).alias("_run")
    )
    tails = runs.select(key, F.split("_run", " ").alias("_words")).select(key, "_words", F.posexplode("_words").alias("_at", "_first"))
    tails = tails.select(key, F.slice("_words", F.col("_at") + 1, max(NAME_WORDS, deepest)).alias("_tail")).distinct()
    depths = F.sequence(F.lit(1), F.least(F.size("_tail"), F.lit(deepest)))
    paths = tails.select(key, "_tail", F.explode(depths).alias("_depth"))
    paths = paths.withColumn("_word", F.lower(F.array_join(F.slice("_tail", F.lit(1), F.col("_depth")), " ")))
    starts = _listed(paths, listed).select(key, "_tail", "_depth")
    if deepest > 1:
        starts = starts.groupBy(key, "_tail").agg(F.min("_depth").alias("_depth"))
    readings = F.transform(F.sequence(F.col("_depth"), F.size("_tail")), lambda n: F.array_join(F.slice("_tail", F.lit(1), n), " "))
    return starts.select(
        key, F.lit(patterns.NAMES).alias("category"), F.explode(readings).alias("match"), F.array_join("_tail", " ").alias("tail")
    )


def candidates(
    samples: DataFrame,
    registry: tuple[patterns.Extractor, ...] = patterns.DEFAULT,
    names: DataFrame | None = None,
    key: str = "sample_id",
) -> DataFrame:
    """Distinct matches of each sample and category: (key, category, match, tail).

    De-duplication happens inside the row, so no shuffle is needed. ``tail`` is set
    for the readings of a name, of which one at most is kept for each tail.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(e.name).alias("category"),
                F.array_distinct(e.find(F.col("text"))).alias("matches"),
            )
            for e in registry
            if e.find is not None
        ]
    )
    out = (
        samples.select(key, F.explode(found).alias("_f"))
        .select(key, F.col("_f.category").alias("category"), F.explode("_f.matches").alias("match"))
        .filter(F.col("match") != "")
        .withColumn("tail", F.lit(None).cast("string"))
    )
    if names is not None and any(e.name == patterns.NAMES for e in registry):
        out = out.unionByName(name_matches(samples, names, key))
    return out


def distinct_terms(cands: DataFrame) -> DataFrame:
    """Each lower-cased string once, so it is looked up once."""
    return cands.select(F.lower("match").alias("term")).distinct()


def corpus_hits(terms: DataFrame, lines: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The ``term`` values that are a substring of some line of the ``line`` values.

    Up to ``automaton_chars`` characters of terms go to the tasks as one search
    automaton, whose cost per line doesn't depend on the number of terms or on
    what they share, in one pass over the corpus. Beyond, terms meet the corpus by
    anchor grams in a shuffle. A term with a line break is in no line.
    """
    inside = (F.col("term") != "") & ~F.col("term").rlike(LINE_BREAK)
    terms = materialise(terms.select("term").filter(inside).distinct(), "terms")
    total = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if total <= automaton_chars:
        return search.by_automaton(terms, lines)
    return search.by_anchor(terms, lines, automaton_chars)


def keep_found(cands: DataFrame, hits: DataFrame, key: str = "sample_id") -> DataFrame:
    """Candidates whose lower-cased match is among ``hits``: (key, category, match).

    Of the readings of one tail the longest stays.
    """
    tagged = cands.withColumn("_term", F.lower("match"))
    hits = materialise(hits.select(F.col("term").alias("_term")), "hits")
    if fits_broadcast(hits):
        kept = tagged.join(F.broadcast(hits), "_term", "left_semi")
    else:
        weights = materialise(
            tagged.groupBy("_term")
            .agg(F.count("*").alias("_n"))
            .join(hits, "_term", "left_semi")
            .withColumn("_ok", F.lit(True)),
            "hit-weights",
        )
        total = weights.agg(F.sum("_n")).first()[0] or 0
        kept = lookup(tagged, weights, "_term", "_n", ["_ok"], total, "inner")
    kept = kept.select(*cands.columns)
    if "tail" not in cands.columns:
        return kept
    whole = kept.filter("tail IS NULL").drop("tail")
    named = kept.filter("tail IS NOT NULL").groupBy(key, "category", "tail").agg(F.max_by("match", F.length("match")).alias("match"))
    return whole.unionByName(named.select(*whole.columns).distinct())


def found_in_corpus(cands: DataFrame, lines: DataFrame, **limits: int) -> DataFrame:
    """Candidates that occur, case-blind, inside one line of the corpus: (key, category, match).

    ``lines`` holds the lines of the corpus or its texts, lower-cased.
    """
    cands = materialise(cands, "candidates")
    key = next(c for c in cands.columns if c not in ("category", "match", "tail"))
    return keep_found(cands, corpus_hits(distinct_terms(cands), lines, **limits), key)


def leak_examples(found: DataFrame) -> DataFrame:
    """Distinct leaked strings per category, one row each."""
    return found.select("category", "match").distinct()


def leak_counts(found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per category: samples with a leak, and leaks. ``leak_examples`` has the strings."""
    return found.groupBy("category").agg(
        F.count_distinct(key).alias("unique_sample_count"),
        F.count("*").alias("total_match_count"),
    )


def with_examples(counts: DataFrame, found: DataFrame) -> DataFrame:
    """Counts with the sorted leaked strings of each category in one cell.

    Only for the summary file, whose format asks for it: a cell grows with the
    category.
    """
    joined = (
        leak_examples(found)
        .groupBy("category")
        .agg(F.array_join(F.array_sort(F.collect_list("match")), "; ").alias("examples"))
    )
    filled = counts.join(joined, "category", "left")
    return filled.withColumn("examples", F.coalesce("examples", F.lit("")))


def category_table(spark, registry: tuple[patterns.Extractor, ...] = patterns.DEFAULT) -> DataFrame:
    """One row per registered category: (ord, category, is_pii)."""
    return spark.createDataFrame(
        [(i, e.name, e.is_pii) for i, e in enumerate(registry)],
        "ord int, category string, is_pii boolean",
    )


def zero_fill(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category in registry order, zeros where nothing leaked."""
    filled = categories.join(F.broadcast(counts), "category", "left")  # a row per category
    columns = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts.columns if c != "category"]
    return filled.select("ord", "category", "is_pii", *columns).orderBy("ord")


def audit_totals(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Total samples and the sums over personal-data categories."""
    n_samples = samples.agg(F.count("*").alias("value")).select(
        F.lit("Total Samples").alias("metric"), "value"
    )
    pii = counts.agg(
        F.coalesce(F.sum(F.when(F.col("is_pii"), F.col("unique_sample_count"))), F.lit(0)).alias("s"),
        F.coalesce(F.sum(F.when(F.col("is_pii"), F.col("total_match_count"))), F.lit(0)).alias("m"),
    ).selectExpr(
        "stack(2, 'Total PII Sample Matches', s, 'Total PII Match Occurrences', m) AS (metric, value)"
    )
    return n_samples.unionByName(pii)


def compare_plain_dp(plain: DataFrame, private: DataFrame) -> DataFrame:
    """Leaks per category under both variants and the relative reduction."""
    p = plain.select("category", F.col("total_match_count").alias("plain_matches"))
    d = private.select("category", F.col("total_match_count").alias("dp_matches"))
    zero = F.lit(0).cast("bigint")
    return p.join(d, "category", "full_outer").select(
        "category",
        F.coalesce("plain_matches", zero).alias("plain_matches"),
        F.coalesce("dp_matches", zero).alias("dp_matches"),
        F.try_divide(
            (F.coalesce("plain_matches", zero) - F.coalesce("dp_matches", zero)).cast("double"),
            F.coalesce("plain_matches", zero).cast("double"),
        ).alias("reduction"),
    )
