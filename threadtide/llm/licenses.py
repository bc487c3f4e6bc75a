"""Licence scans in DataFrame operations only.

Every line of a file, and the whole of a licence file, is compared with templates by the cosine of sparse
TF-IDF vectors. Document frequencies come from all files. A line can only reach the threshold if it has
one of the few heaviest terms of a template (without them the rest of the template is too short), so only
such lines are taken apart. Files without a licence of their own take that of the nearest directory above
them that holds a licence file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from threadtide.llm.shared import cut

#: (licence, notice). The public notices of these licences.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)
THRESHOLD = 0.8
#: A file with this share of its words in matched lines is a licence file, as is one with such a name.
LICENSE_SHARE = 0.2
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(_UPPER, _LOWER))
    return [t for t in "".join(c if c in _LOWER + "0123456789" else " " for c in lowered).split()]


def _terms(text: Column) -> Column:
    """Runs of letters a-z and digits, in order."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != "")


def idf(count: int, holding: int) -> float:
    return math.log((1 + count) / (1 + holding)) + 1


def weights(templates: tuple[tuple[str, str], ...], frequency: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, notice in templates:
        terms = terms_of(notice)
        vector = {t: terms.count(t) * frequency[t] for t in sorted(set(terms))}
        norm = math.sqrt(sum(w * w for w in vector.values()))
        out.append({t: w / norm for t, w in vector.items()})
    return out


def anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text needs one to reach the threshold with some template."""
    out = set()
    for vector in vectors:
        rest = 1.0
        for term, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(rest, 0)) < threshold - 1e-9:
                break
            out.add(term)
            rest -= weight * weight
    return sorted(out)


def segments(files: DataFrame, heavy: list[str]) -> DataFrame:
    """id, path, line (-1: the whole file), text of all lines with a heavy term, and of all files with a licence file's name."""
    pattern = rf"(^|[^a-z0-9])({'|'.join(heavy)})([^a-z0-9]|$)"
    has = F.translate("text", _UPPER, _LOWER).rlike(pattern)
    lines = files.where(has).select("id", "path", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(has)
    named = files.where(file_name(F.col("path")).rlike(LICENSE_NAME)).select("id", "path", F.lit(-1).alias("line"), "text")
    return lines.unionByName(named)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path up to its last slash (the root is an empty text)."""
    return F.regexp_replace(path, "/[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, the nearest first."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def matches(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, line, words, license, score of the best template of every segment that reaches the threshold."""
    spark = files.sparkSession
    vocabulary = sorted({t for _, notice in templates for t in terms_of(notice)})
    held = F.array_intersect(_terms(F.col("text")), F.array(*(F.lit(t) for t in vocabulary)))
    counted = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count()
    frequency = {r["term"]: r["count"] for r in counted.collect()}  # a row for each word of the templates
    total = frequency.get("", 0)
    scale = {t: idf(total, frequency.get(t, 0)) for t in vocabulary}
    vectors = weights(templates, scale)
    known = F.broadcast(spark.createDataFrame(list(scale.items()), "term string, idf double"))
    entries = F.broadcast(spark.createDataFrame(
        [(t, name, k, w) for k, ((name, _), vector) in enumerate(zip(templates, vectors)) for t, w in vector.items()],
        "term string, license string, template int, weight double",
    ))
    counts = (
        segments(files, anchors(vectors, threshold)).distinct().select("id", "path", "line", F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("id", "path", "line", "term").agg(F.count("*").alias("tf"))
    )
    weighted = counts.join(known, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(idf(total, 0))))
    norms = weighted.groupBy("id", "path", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = weighted.join(entries, "term").groupBy("id", "path", "line", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = [dots[c].eqNullSafe(norms[c]) for c in ("id", "path", "line")]
    scored = dots.join(norms, same[0] & same[1] & same[2]).select(
        dots["id"], dots["path"], dots["line"], "words", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")
    ).where(F.col("score") >= threshold)
    best = F.max(F.struct("score", F.struct(_after("license").alias("order"), F.col("license").alias("license")).alias("choice")))
    return scored.groupBy("id", "path", "line", "words").agg(best.alias("b")).select(
        "id", "path", "line", "words", F.col("b.choice.license").alias("license"), "b.score"
    )


def _after(name: str) -> Column:
    """Larger for the name that sorts first, so that ties go to it."""
    return F.translate(F.rpad(F.lower(name), 24, " "), " -.0123456789abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba9876543210.- ")


def scan(
    frame: DataFrame, key: str, path: Column, text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """key, path, license, score, origin, inherited_from of every row.

    origin is own (a line, or the whole of a licence file, matches), inherited (from the directory
    inherited_from) or none. Of several own matches the best counts, then the first by name; of several
    licence files in a directory the first by path. Null texts are empty; rows with a null key or path have
    no licence file's effect and inherit nothing; rows that are equal in key, path and text are one file.
    Other columns are not read.
    """
    files = frame.select(F.col(key).alias("id"), path.alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    found = cut(matches(files, templates, threshold))
    choice = F.max(F.struct("score", _after("license").alias("order"), "license")).alias("b")
    lines = found.where("line >= 0").groupBy("id", "path").agg(F.sum("words").alias("matched"))
    own = found.groupBy("id", "path").agg(choice).select("id", "path", F.col("b.license").alias("own"), F.col("b.score").alias("own_score"))
    sizes = files.where(F.col("path").isNotNull()).join(
        own.select("id", "path").where(F.col("id").isNotNull() & F.col("path").isNotNull()), ["id", "path"], "left_semi"
    ).groupBy("id", "path").agg(F.max(F.size(_terms(F.col("text")))).alias("words"))
    license_files = own.join(sizes, ["id", "path"]).join(lines, ["id", "path"], "left").where(
        file_name(F.col("path")).rlike(LICENSE_NAME) | (F.coalesce("matched", F.lit(0)) >= LICENSE_SHARE * F.col("words"))
    )
    held = license_files.groupBy(directory(F.col("path")).alias("folder")).agg(F.min_by(F.struct("own", "path"), F.struct("path", "own")).alias("h"))
    folders = files.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("folder")).distinct()
    above = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("steps", "above"))
    nearest = above.join(held.select(F.col("folder").alias("above"), F.col("h.own").alias("given")), "above").groupBy("folder").agg(
        F.min_by(F.struct("given", "above"), "steps").alias("n")
    )
    rows = files.select("id", "path").withColumn("folder", F.when(F.col("id").isNotNull(), directory(F.col("path"))))
    mine = own.select(F.col("id").alias("own_id"), F.col("path").alias("own_path"), "own", "own_score")
    joined = rows.join(mine, F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").join(nearest, "folder", "left")
    return joined.select(
        F.col("id").alias(key), "path",
        F.coalesce("own", "n.given").alias("license"),
        F.col("own_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("n.above")).alias("inherited_from"),
    )


def document_path() -> Column:
    """Where a document lies in the tree of its table: /source/lang/doc_id."""
    return F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.col("doc_id").cast("string"))


def oracle() -> str:
    """The scan of `documents` in SQL, without the anchors: every line is compared."""
    values = ", ".join(f"({k}, '{name}', '{notice}')" for k, (name, notice) in enumerate(TEMPLATES))
    split = "list_filter(regexp_split_to_array(translate({}, '" + _UPPER + "', '" + _LOWER + "'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH templates(template, license, notice) AS (VALUES {values}),
files AS (SELECT doc_id AS id, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents),
tterms AS (SELECT template, license, unnest({split.format('notice')}) AS term FROM templates),
vocabulary AS (SELECT DISTINCT term FROM tterms),
total AS (SELECT count(*) AS n FROM files),
held AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({split.format('text')}) AS term FROM files) SEMI JOIN vocabulary USING (term) GROUP BY term),
known AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN held USING (term) CROSS JOIN total),
tw AS (SELECT template, license, term, count(*) * any_value(idf) AS w FROM tterms JOIN known USING (term) GROUP BY ALL),
tn AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM tw),
lines AS (SELECT id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM files),
lterms AS (SELECT id, path, k, unnest({split.format('line')}) AS term FROM lines),
counted AS (SELECT id, path, k, term, count(*) AS tf FROM lterms GROUP BY ALL),
weighted AS (SELECT id, path, k, term, tf, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM counted LEFT JOIN known USING (term) CROSS JOIN total),
norms AS (SELECT id, path, k, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM weighted GROUP BY ALL),
dots AS (SELECT id, path, k, template, license, sum(w * weight) AS dot FROM weighted JOIN tn USING (term) GROUP BY ALL),
scored AS (SELECT id, path, k, words, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (id, path, k) WHERE round(dot / norm, 6) >= {THRESHOLD}),
best AS (SELECT id, path, k, any_value(words) AS words, arg_max(license, score) AS license, max(score) AS score FROM scored GROUP BY id, path, k),
own AS (SELECT id, path, arg_max(license, score) AS own, max(score) AS own_score, sum(words) AS matched FROM best GROUP BY id, path),
license_files AS (
  SELECT own.*, regexp_replace(path, '/[^/]*$', '') AS folder FROM own JOIN files USING (id, path)
  WHERE matched >= {LICENSE_SHARE} * len({split.format('text')})
),
given AS (SELECT folder, arg_min(own, path) AS given FROM license_files GROUP BY folder),
rows_ AS (SELECT id, path, regexp_replace(path, '/[^/]*$', '') AS d1, regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') AS d2 FROM files)
SELECT id AS doc_id, path, coalesce(own, a.given, b.given, c.given) AS license, own_score AS score,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN coalesce(a.given, b.given, c.given) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own IS NOT NULL THEN NULL WHEN a.given IS NOT NULL THEN d1 WHEN b.given IS NOT NULL THEN d2 WHEN c.given IS NOT NULL THEN '' END AS inherited_from
FROM rows_ LEFT JOIN own USING (id, path) LEFT JOIN given a ON a.folder = d1 LEFT JOIN given b ON b.folder = d2 LEFT JOIN given c ON c.folder = ''"""
