"""Licence detection by sparse TF-IDF cosine against templates, and inheritance from the nearest directory above.

Candidate lines are those that hold a cue word; texts are searched whole. Each candidate's terms are weighted by term
frequency and by inverse document frequency over the templates, and joined to the templates' weights by term. A licence
file's best match covers its directory; a file without a match of its own takes that of the nearest directory above it that
has one. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|redistribution"
TERM = r"[^a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying)"
THRESHOLD = 0.6
MAX_TEMPLATES = 1000  # bound of the broadcast
#: Short notices; standard wordings, which must be matched as they are.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


def template_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, float]:
    """((licence, term, w) with unit vectors, weight of a term that no template has)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    n = float(len(templates))
    tf = spark.createDataFrame(templates, "licence string, text string").select("licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").select("licence", "term", F.log((n + 1) / (F.col("df") + 1)).alias("idf"), "tf").withColumn("w", F.col("tf") * (F.col("idf") + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("licence")))
    import math

    return w.select("licence", "term", (F.col("idf") + 1).alias("idf"), (F.col("w") / norm).alias("w")), math.log(n + 1) + 1


def matches(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, licence, score): the best template of each file with a line that reaches the threshold; ties by name.

    ``files`` has row (unique) and text. Only cue lines are exploded; the templates' weights have a bounded size and are broadcast.
    """
    weights, other = template_weights(files.sparkSession, templates)
    weights = staged(weights)
    lines = files.where(F.col("text").rlike(CUE)).select("row", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(CUE))
    tf = lines.select("row", "line", F.explode(terms(F.col("text"))).alias("term")).groupBy("row", "line", "term").agg(F.count("*").cast("double").alias("tf"))
    idf = weights.groupBy("term").agg(F.max("idf").alias("idf"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norm = tf.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.where("idf is not null").join(F.broadcast(weights.select("licence", "term", "w")), "term").groupBy("row", "line", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norm, ["row", "line"]).select("row", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("row", "licence").agg(F.max("score").alias("score")).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("row", "b.licence", (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file: the columns of ``files`` but text, and licence, score, via (own, inherited or null), licensed_by.

    ``files`` has path and text, and may have more. A null text has no line. A null path is in no directory. Of several licence
    files in a directory the best score counts, then the smallest path. Repeated rows are scanned each. An empty table
    gives none.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "text"]).alias("_file")
    named = files.select(kept, "path", "text", F.monotonically_increasing_id().alias("row"))
    own = matches(named.select("row", "text"), templates, threshold)
    rest = named.drop("text")
    found = own.select(F.col("row").alias("_row"), F.col("licence").alias("own"), F.col("score").alias("own_score"))
    rows = staged(rest.join(found, rest.row == found._row, "left").drop("_row"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    rows = rows.withColumn("folder", folder)
    name = F.substring_index("path", "/", -1)
    grants = rows.where(F.col("own").isNotNull() & name.rlike(LICENCE_FILE)).groupBy(F.col("folder").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own").alias("l"))).alias("g"))
    # Folders are far fewer than files: each once, with all folders above it, joined to the grants; the deepest one stays.
    parts = F.split("folder", "/")
    ups = rows.where("folder is not null").select("folder").distinct().select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/")).dropDuplicates(["folder", "above"])
    nearest = ups.join(grants, "above").groupBy("folder").agg(F.max(F.struct("depth", "g")).alias("n")).select(F.col("folder").alias("_folder"), F.col("n.g").alias("g"))
    out = rows.join(nearest, rows.folder == nearest._folder, "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "_file.*", F.coalesce("own", "g.l").alias("licence"), F.coalesce("own_score", -F.col("g.s")).alias("score"),
        F.when(mine, "own").when(F.col("g").isNotNull(), "inherited").alias("via"), F.when(mine, F.col("path")).otherwise(F.col("g.p")).alias("licensed_by"),
    )
