"""Flat-file rows to a vocabulary of models, and spellings to listed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text


def clean_rows(raw: DataFrame) -> DataFrame:
    """One row per bulletin, model and year; rows without id, make, model or year, and models named as their make, go."""
    year = F.trim(F.col("year_text"))
    cut = raw.select(
        F.trim("raw_id").alias("bulletin_id"), F.upper(F.trim("raw_make")).alias("make"), F.upper(F.trim("raw_model")).alias("upper_model"),
        text.normal_model(F.col("raw_model")).alias("model"), F.explode(F.split("raw_years", ",")).alias("year_text"), F.trim("summary").alias("summary"), "source_window",
    )
    kept = (F.col("bulletin_id") != "") & (F.col("make") != "") & (F.col("model") != "") & (F.col("make") != F.col("upper_model")) & year.rlike("^[0-9]+$")
    return cut.filter(kept).select("bulletin_id", "make", "model", year.try_cast("int").alias("model_year"), "summary", "source_window")


def vocabulary(rows: DataFrame) -> DataFrame:
    """Distinct bulletins by year, make, model and window."""
    return rows.groupBy("model_year", "make", "model", "source_window").agg(F.countDistinct("bulletin_id").alias("bulletins"))


def resolved_models(vocab: DataFrame) -> DataFrame:
    """Every spelling and the name it is listed as, by year and make.

    Spellings with one compact key fold into the one with most bulletins (ties: more spaces, then
    the smaller). A name marked as a copy takes the listed name of its key, else the only listed
    name whose key begins or ends with its key (three characters or more), else itself. Beginnings
    and ends are joined on equality: each listed key is spread into its own prefixes and suffixes,
    a few rows a name, so no pair of names is formed that does not match.
    """
    by = ["model_year", "make"]
    counts = vocab.groupBy(*by, "model").agg(F.sum("bulletins").alias("n"))
    named = counts.withColumn("junk", text.is_junk(F.col("model"))).withColumn("key", text.compact_model(text.without_junk(F.col("model"))))
    spaces = F.length("model") - F.length(F.translate("model", " ", ""))
    best = F.min_by("model", F.struct(-F.col("n"), -spaces, F.col("model"))).alias("listed")
    real = named.filter(~F.col("junk"))
    listed = real.groupBy(*by, "key").agg(best)
    out_real = real.join(listed, [*by, "key"]).select(*by, "model", "listed")
    junk = named.filter("junk").join(listed.withColumnRenamed("listed", "same"), [*by, "key"], "left")
    ends = F.expr(f"transform(sequence({text.MIN_ALIAS_KEY}, length(key)), i -> array(substring(key, 1, i), right(key, i)))")
    parts = listed.filter(F.length("key") >= text.MIN_ALIAS_KEY).select(*by, "listed", F.explode(F.array_distinct(F.flatten(ends))).alias("key"))
    only = parts.groupBy(*by, "key").agg(F.count("*").alias("found"), F.min("listed").alias("near")).filter("found = 1").drop("found")
    out_junk = junk.join(only, [*by, "key"], "left").select(*by, "model", F.coalesce("same", "near", "model").alias("listed"))
    return out_real.unionByName(out_junk)


def own_spelling_first(rows: DataFrame, resolved: DataFrame, cars: DataFrame) -> DataFrame:
    """Bulletins of each car, matched by every spelling of its model; one row each, the car's own spelling before others."""
    spelled = rows.join(resolved, ["model_year", "make", "model"])
    own = cars.join(resolved.select("model_year", "make", F.col("model").alias("car_model"), F.col("listed")), ["model_year", "make", "car_model"])
    both = own.join(spelled, ["model_year", "make", "listed"])
    best = F.min_by(F.struct("model", "summary", "source_window"), F.struct(F.col("model") != F.col("car_model"), "model", F.col("source_window"), F.col("summary")))
    return both.groupBy("model_year", "make", "car_model", "bulletin_id").agg(best.alias("b")).select("model_year", "make", "car_model", "bulletin_id", "b.*")


def longest_prefix(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """The listed name that is the name itself, else its longest whole-word beginning, else its longest compact beginning.

    The name is spread into its own beginnings, joined on equality.
    """
    words = F.split("canonical", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    by_word = names.select("canonical", F.explode(starts).alias("target")).join(vocab.select(F.col("model").alias("target")).distinct(), "target", "left_semi")
    found = by_word.groupBy("canonical").agg(F.max_by("target", F.length("target")).alias("by_word"))
    compact = vocab.select("model").distinct().withColumn("part", text.compact_model(F.col("model"))).filter("part <> ''").groupBy("part").agg(F.max("model").alias("model"))
    letters = names.withColumn("c", text.compact_model(F.col("canonical"))).filter("c <> ''")
    cut = letters.select("canonical", F.explode(F.expr("transform(sequence(1, length(c)), i -> substring(c, 1, i))")).alias("part")).join(compact, "part")
    loose = cut.groupBy("canonical").agg(F.max_by("model", F.struct(F.length("part"), F.col("model"))).alias("loose"))
    return names.join(found, "canonical", "left").join(loose, "canonical", "left").select("canonical", F.coalesce("by_word", "loose").alias("target"))


def newest_window(rows: DataFrame) -> DataFrame:
    """A bulletin of a model listed in several windows stands with the newest."""
    newest = Window.partitionBy("bulletin_id", "make", "model", "model_year").orderBy(F.col("source_window").desc(), F.col("summary"))
    return rows.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")


def stale_windows(seen: DataFrame, recorded: DataFrame) -> DataFrame:
    """Windows whose tag is new or other than the recorded one, null-safe."""
    both = seen.alias("s").join(recorded.alias("r"), "source_window", "left")
    return both.filter(~F.col("s.etag").eqNullSafe(F.col("r.etag"))).select("source_window", F.col("s.etag").alias("etag"))


def any_of(column: Column, patterns: list[str]) -> Column:
    """LIKE ANY (F09)."""
    found = F.lit(False)
    for p in patterns:
        found = found | column.like(p)
    return found


def prefill_plan(seeds: DataFrame, cars: DataFrame, vocab: DataFrame, documents_per_bulletin: float, cost_per_document: float) -> DataFrame:
    """For each listed car, the one there is, the bulletins listed under any spelling of its name, and what they would cost (Q25)."""
    named = seeds.select("year", F.upper(F.trim("make")).alias("make"), text.normal_model(F.col("model")).alias("model"))
    existing = cars.groupBy("year", "make", "model").agg(F.min("car_id").alias("car_id"))
    spelled = resolved_models(vocab).select(F.col("model_year").alias("year"), "make", "model", "listed")
    counts = vocab.select(F.col("model_year").alias("year"), "make", "model", "bulletins").join(spelled, ["year", "make", "model"]).groupBy("year", "make", "listed").agg(F.sum("bulletins").alias("n"))
    listed = spelled.join(counts, ["year", "make", "listed"]).select("year", "make", "model", "n")
    both = named.join(existing, ["year", "make", "model"], "left").join(listed, ["year", "make", "model"], "left").withColumn("n_bulletins", F.coalesce("n", F.lit(0)))
    documents = F.ceil(F.col("n_bulletins") * documents_per_bulletin)
    return both.select("year", "make", "model", "car_id", "n_bulletins", documents.alias("n_documents"), F.round(documents * cost_per_document, 4).alias("cost_usd"))
