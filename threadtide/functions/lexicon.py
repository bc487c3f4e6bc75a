"""Lexicon sentiment as one map-only expression (published VADER rules, Hutto & Gilbert 2014).

The lexicon travels in the plan as hashed membership sets, so scoring a text needs no join,
no shuffle and no Python worker, and a long text stays within its own row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from threadtide.functions.binding import bind
from threadtide.functions.text import SPACES
from threadtide.operators import bounded

# Constants of the published rules.
BOOST = 0.293
DAMPING = [1.0, 0.95, 0.9]
NEGATION = -0.74
ALPHA = 15.0
# Negators that can survive the removal of punctuation and stop words.
NEGATORS = """
aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt
neither neednt never none nope nothing nowhere oughtnt shant shouldnt uhuh wasnt werent without
wont wouldnt rarely seldom despite not nor
""".split()
# Intensifiers (+) and dampeners (-).
BOOSTERS = {
    **dict.fromkeys(
        """absolutely amazingly awfully completely considerably decidedly deeply enormously entirely
        especially exceptionally extremely fabulously fully greatly highly hugely incredibly intensely
        majorly more most particularly purely quite really remarkably substantially thoroughly totally
        tremendously unbelievably unusually utterly very""".split(), 1),
    **dict.fromkeys(
        "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split(), -1),
}
# A lexicon in the plan is a literal, with one hashed set per distinct valence; larger tables are joined.
MAX_TERMS = 50_000
MAX_VALENCES = 200
# Distinct tokens of a table of texts that may be broadcast to find the terms that occur.
MAX_TOKENS = 500_000


@dataclass(frozen=True)
class Lexicon:
    valence: Mapping[str, float]
    boosters: Mapping[str, int] = field(default_factory=lambda: BOOSTERS)
    negators: tuple[str, ...] = tuple(NEGATORS)

    @classmethod
    def from_table(cls, df: DataFrame, term: str = "term", valence: str = "valence") -> "Lexicon":
        """Read a (term, valence) table after checking its size."""
        rows = df.select(term, F.col(valence).cast("double")).limit(MAX_TERMS + 1).toArrow().to_pydict()
        if len(rows[term]) > MAX_TERMS:
            raise ValueError(f"lexicon has more than {MAX_TERMS} terms: use add_sentiment_with_table")
        return cls(dict(zip(rows[term], rows[valence])))


def _lookup(token: Column, table: Mapping[str, float], default: float) -> Column:
    """Value of a token: one hashed set per distinct value."""
    by_value = defaultdict(list)
    for term, value in table.items():
        by_value[value].append(term)
    out = None
    for value, terms in sorted(by_value.items()):
        hit = token.isin(terms)
        out = F.when(hit, F.lit(float(value))) if out is None else out.when(hit, F.lit(float(value)))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _hit_valence(tokens: Column, valences: Column, i: Column, lexicon: Lexicon) -> Column:
    """Valence of the term at i after the three tokens before it have acted on it; terms do not act."""
    def step(v: Column, d: Column) -> Column:
        word = F.get(tokens, i - d)
        acts = F.get(valences, i - d).isNull()
        damp = F.get(F.array(*[F.lit(x) for x in DAMPING]), d - 1)
        shift = damp * BOOST * _lookup(word, lexicon.boosters, 0.0) * F.signum(v)
        flips = word.isin(list(lexicon.negators))
        return F.when(acts, (v + shift) * F.when(flips, NEGATION).otherwise(1.0)).otherwise(v)

    value = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.get(valences, i), step)
    return value * F.when(F.get(tokens, i - 1) == "least", NEGATION).otherwise(1.0)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: F.length(t) > 1)


def _score(tokens: Column, valences: Column, lexicon: Lexicon) -> Column:
    """Struct (neg, neu, pos, compound) from a text's tokens and, beside each, its valence or null."""
    total = lambda values, part: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + part(v))

    def hits(vals: Column) -> Column:
        positions = F.array_compact(F.transform(vals, lambda v, i: F.when(v.isNotNull(), i)))
        return F.transform(positions, lambda i: _hit_valence(tokens, vals, i, lexicon))

    def sums(values: Column) -> Column:
        return F.struct(
            total(values, lambda v: v).alias("s"),
            total(values, lambda v: F.when(v > 0, v + 1).otherwise(0.0)).alias("p"),
            total(values, lambda v: F.when(v < 0, 1 - v).otherwise(0.0)).alias("n"),
            (F.size(tokens) - F.size(F.filter(values, lambda v: v != 0))).cast("double").alias("u"),
        )

    def shares(x: Column) -> Column:
        size = x["p"] + x["n"] + x["u"]
        share = lambda part: F.when(size > 0, F.round(part / size, 3)).otherwise(0.0)
        return F.struct(
            share(x["n"]).alias("neg"), share(x["u"]).alias("neu"), share(x["p"]).alias("pos"),
            F.round(x["s"] / F.sqrt(x["s"] * x["s"] + ALPHA), 4).alias("compound"),
        )

    return bind(bind(bind(valences, hits), sums), shares)


def sentiment(text: Column, lexicon: Lexicon) -> Column:
    """Struct (neg, neu, pos, compound) of a text; a text without tokens gives four zeros."""
    terms = {t: v for t, v in lexicon.valence.items() if t not in lexicon.boosters}
    value = lambda t: F.when(t.isin(list(terms)), _lookup(t, terms, 0.0))
    return bind(_tokens(text), lambda tok: _score(tok, F.transform(tok, value), lexicon))


def add_sentiment(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """Add neg/neu/pos/compound_sentiment of a text column."""
    scored = df.withColumn("_score", sentiment(F.col(text), lexicon))
    parts = ["neg", "neu", "pos", "compound"]
    return scored.withColumns({f"{p}_sentiment": F.col("_score")[p] for p in parts}).drop("_score")


def add_sentiment_with_table(
    df: DataFrame, row_id: str, text: str, terms: DataFrame, term: str = "term", valence: str = "valence",
    boosters: Mapping[str, int] = BOOSTERS, negators: tuple[str, ...] = tuple(NEGATORS),
) -> DataFrame:
    """The columns of ``add_sentiment`` from a (term, valence) table of any size; row_id must be unique.

    A pass over the texts finds the terms that occur in them. Up to MAX_TERMS of these (of at most MAX_VALENCES
    valences) become the plan's literal lexicon, so that no token leaves its row. Of more terms, tokens meet
    the table in a left join and return to their row in their old order. A term that stands twice counts with its
    larger valence.
    """
    rules = Lexicon({}, boosters, negators)
    table = terms.select(F.col(term).alias("_token"), F.col(valence).cast("double").alias("_valence")).where(
        F.col("_valence").isNotNull() & ~F.col("_token").isin(list(boosters))
    )
    words = df.select(F.explode(F.array_distinct(_tokens(F.col(text)))).alias("_token")).distinct()
    table = table.join(bounded.small_side(words, MAX_TOKENS), "_token", "left_semi").groupBy("_token").agg(F.max("_valence").alias("_valence"))
    found = table.limit(MAX_TERMS + 1).toArrow().to_pydict()
    if len(found["_token"]) <= MAX_TERMS and len(set(found["_valence"])) <= MAX_VALENCES:
        occurring = Lexicon(dict(zip(found["_token"], found["_valence"])), boosters, negators)
        return add_sentiment(df.select(row_id, *[c for c in df.columns if c != row_id]), text, occurring)
    spread = df.select(row_id, F.posexplode(_tokens(F.col(text))).alias("_at", "_token")).join(table, "_token", "left")
    rows = spread.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("_at", "_token", "_valence"))).alias("_all"))
    empty = F.array().cast("array<struct<_at:int,_token:string,_valence:double>>")
    scored = df.join(rows, row_id, "left").withColumn("_all", F.coalesce("_all", empty))
    score = bind(F.col("_all"), lambda x: _score(x["_token"], x["_valence"], rules))
    scored = scored.withColumn("_score", score)
    return scored.withColumns({f"{p}_sentiment": F.col("_score")[p] for p in ("neg", "neu", "pos", "compound")}).drop("_score", "_all")
