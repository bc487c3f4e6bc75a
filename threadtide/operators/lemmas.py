"""Lemmas from a table that is too large for a plan literal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from threadtide.operators import bounded

MAX_BROADCAST_LEMMAS = 500_000
# Noun endings and what stands in their place.
DETACHMENTS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
#: How often the rules are applied to their own results where the dictionary knows none of the first.
ROUNDS = 3


def lemmatize_with_table(
    df: DataFrame, row_id: str, tokens: Column, lemmas: DataFrame, output: str, max_broadcast: int = MAX_BROADCAST_LEMMAS
) -> DataFrame:
    """Add the tokens, each replaced by its lemma where the (token, lemma) table has one, joined by a space.

    row_id must be unique. Tokens meet the table in a left join (broadcast once its size is
    checked) and return to their row in their old order; a row without tokens gets ''. With a broadcast
    table the rows are dealt by their id first, so that whole texts are shuffled and not their tokens.
    """
    local, small = bounded.materialize_small(lemmas.select("token", "lemma").dropDuplicates(["token"]), max_broadcast)
    table = F.broadcast(local) if small else local
    df = df.repartition(row_id) if small else df
    spread = df.select(row_id, F.posexplode(tokens).alias("_pos", "token"))
    mapped = spread.join(table, "token", "left").select(
        row_id, F.struct("_pos", F.coalesce("lemma", "token").alias("t")).alias("_t")
    )
    texts = mapped.groupBy(row_id).agg(F.sort_array(F.collect_list("_t"))["t"].alias("_texts"))
    joined = df.join(texts, row_id, "left")
    return joined.withColumn(output, F.coalesce(F.array_join("_texts", " "), F.lit(""))).drop("_texts")


def _detached(form: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The forms that the rules make of one form."""
    made = [F.when(form.endswith(end), F.concat(form.substr(F.lit(1), F.length(form) - len(end)), F.lit(new))) for end, new in rules]
    return F.filter(F.array(*made), lambda f: f.isNotNull() & (f != ""))


def dictionary_lemmas(
    tokens: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, rules: Sequence[tuple[str, str]] = DETACHMENTS, rounds: int = ROUNDS
) -> DataFrame:
    """(token, lemma) of every distinct token that the dictionary (word) knows in some form.

    A token's forms are itself and what each rule makes of it; only forms in the dictionary count, the shortest
    wins, ties go by the form. Where none is known, the rules are applied to the forms again. A token of the exceptions
    (token, lemma) has no forms but itself and these lemmas, known to the dictionary as well. Nulls take no
    part, extra columns are not read. Tokens meet the dictionary once each, however often they stand.
    """
    distinct = tokens.select("token").where("token is not null").distinct()
    known = dictionary.select(F.col("word").alias("form")).where("form is not null").distinct()
    forms = [_detached(F.col("token"), rules)]
    for _ in range(rounds - 1):
        forms.append(F.flatten(F.transform(forms[-1], lambda f: _detached(f, rules))))
    levels = F.transform(F.array(F.concat(F.array("token"), forms[0]), *forms[1:]), lambda fs, i: F.transform(fs, lambda f: F.struct(i.alias("level"), f.alias("form"))))
    regular = lambda rows: rows.select("token", F.inline(F.flatten(levels)))
    if exceptions is None:
        candidates = regular(distinct)
    else:
        odd = exceptions.select("token", F.col("lemma").alias("form")).where("token is not null and form is not null").distinct()
        lists = odd.groupBy("token").agg(F.collect_set("form").alias("_odd"))
        marked = distinct.join(lists, "token", "left")
        own = marked.where("_odd is not null").select("token", F.lit(0).alias("level"), F.explode(F.array_union(F.array("token"), "_odd")).alias("form"))
        candidates = regular(marked.where("_odd is null")).unionByName(own)
    hits = candidates.join(known, "form", "left_semi")
    best = F.min(F.struct("level", F.length("form").alias("size"), "form"))
    return hits.groupBy("token").agg(best.getField("form").alias("lemma"))


def lemmatize_with_dictionary(
    df: DataFrame, row_id: str, tokens: Column, dictionary: DataFrame, output: str, exceptions: DataFrame | None = None,
    max_broadcast: int = MAX_BROADCAST_LEMMAS,
) -> DataFrame:
    """`lemmatize_with_table` with the lemmas that a dictionary of any size confirms; unknown tokens stay."""
    spread = df.select(F.explode(tokens).alias("token"))
    return lemmatize_with_table(df, row_id, tokens, dictionary_lemmas(spread, dictionary, exceptions).where("token <> lemma"), output, max_broadcast)
