"""Audit of how far each source of a language strays from the language and from its other sources, in plain relational steps.

Matches of a pattern are exploded and counted by language, source and term; terms in enough documents of a language are its
vocabulary. Sources (and each language as a whole) are crossed with the vocabulary of their language, so that terms they lack count
zero; two parties of a language meet by joining that table with itself on language and term. All arithmetic is on integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import forget, written

#: A term is a match of [^...]+ with this class: a run of ASCII letters and code points beyond ASCII. The runs are what lies between matches of the class itself,
#: and Spark splits a text at those in a fifth of the time that extracting the runs takes.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares are counted in units of one to SCALE.
SCALE = 1_000_000_000


def lowered(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; Spark's own lower() says the same of ASCII texts, much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): every term of docs; nulls count as ''."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source"), F.array_remove(F.split(lowered(text), BETWEEN, -1), "").alias("w"))
    # all matches of a row, then each of its terms once
    both = rows.select("lang", "source", F.explode(F.array(F.struct(F.col("w"), F.lit(1).alias("n"), F.lit(0).alias("docs")), F.struct(F.array_distinct("w").alias("w"), F.lit(0).alias("n"), F.lit(1).alias("docs")))).alias("x"))
    each = both.select("lang", "source", F.col("x.n").alias("n"), F.col("x.docs").alias("docs"), F.explode("x.w").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shares(groups: DataFrame, counted: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every party's smoothed share of every term kept, those it lacks included; parties and terms go by numbers.

    parties: g, lang, source (null: the language as a whole), v (terms kept), total (their occurrences). terms: t, lang, term. shares: g, t, n, p, whole. A
    language without kept terms has none of them. p is 1 + floor(SCALE * (n + 2) / (total + 2 v)).
    """
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = written(kept.select("lang", "term", "n", F.monotonically_increasing_id().alias("t")), "vocabulary")
    here = written(counted.join(kept.select("lang", "term", "t"), ["lang", "term"]).select("lang", "source", "t", "n"), "counts-kept")
    sums = here.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole"))
    parties = groups.join(langs, "lang").join(sums, ["lang", "source"], "left").select("lang", "source", "v", F.coalesce("total", F.lit(0)).alias("total"))
    parties = parties.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), "v", F.col("whole").alias("total")))
    parties = written(parties.withColumn("g", F.monotonically_increasing_id()), "parties")
    dense = parties.where("source is not null").select("lang", "g", "v", "total").join(kept.select("lang", "t"), "lang").drop("lang")
    own = here.join(parties.select("lang", "source", "g"), ["lang", "source"]).select("g", "t", "n")
    dense = dense.join(own, ["g", "t"], "left").select("g", "t", F.coalesce("n", F.lit(0)).alias("n"), "v", "total", F.lit(False).alias("whole"))
    whole = parties.where("source is null").select("lang", "g", "v", "total").join(kept.select("lang", "t", "n"), "lang").select("g", "t", "n", "v", "total", F.lit(True).alias("whole"))
    p = F.expr(f"1 + (cast(n + 2 as decimal(20,0)) * {SCALE}) div (total + 2 * v)")
    out = written(dense.unionByName(whole).select("g", "t", "n", p.alias("p"), "whole"), "shares")
    forget(here)
    return parties, kept.select("t", "lang", "term"), out


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value long, rank int: per source of a language, how far it lies from each other source (part `pair`, all
    ranks), and the terms that it has more of than the language as a whole (part `term`, ranks up to top).

    A term is a run of letters (see BETWEEN), A-Z lower-cased; those in at least min_docs rows of a language are kept. With shares p and q (see shares())
    a term's value is floor((p - q)^2 / (p + q)); a pair's is the sum over all kept terms, 0 where the language keeps none.
    Ranks go from 1 by falling value, ties by rising item in UTF-8. Null text, lang and source count as ''; a row without terms still makes its
    (lang, source) a group; rows that repeat count as often as they stand there; an empty table gives no rows. Columns of docs beside
    the three take no part. A row's matches are held at once, so a text takes some 50 bytes a word in its task.
    """
    counted = written(counts(docs, text_col, lang_col, source_col), "counts")
    groups = written(docs.select(_named(lang_col).alias("lang"), _named(source_col).alias("source")).distinct(), "groups")
    parties, vocabulary, dense = shares(groups, counted, min_docs)
    forget(counted)
    other = dense.select("t", F.col("g").alias("og"), F.col("p").alias("q"), F.col("whole").alias("o_whole"))
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    parted = dense.where("not whole")
    half = parted.join(other.where("not o_whole"), "t").where("g < og").groupBy("g", "og").agg(F.sum(value).alias("value"))
    name = lambda g, c: parties.select(F.col("g").alias(g), F.col("lang").alias("lang" if c == "source" else "ol"), F.col("source").alias(c))
    half = written(half.join(name("g", "source"), "g").join(name("og", "item"), "og").select("lang", "source", "item", "value"), "pairs")
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(ranked))
    above = parted.where("n > 0").join(other.where("o_whole"), "t").where("p > q").select("g", "t", value.alias("value"))
    terms = above.join(vocabulary.select("t", F.col("term").alias("item")), "t").join(name("g", "source"), "g")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
