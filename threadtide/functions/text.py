"""Text expressions. All are built-in Spark functions: no Python worker, no shuffle."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# English stop words (the common 179-word list without the entries that hold
# an apostrophe; punctuation is removed before the look-up, so those can never match).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now d ll m o re ve y ain aren
couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# The 32 ASCII punctuation marks, as ranges inside a regex class.
PUNCTUATION = r"!-/:-@\[-`{-~"

# White space under Unicode rules, as the inside of a regex class. Spelled out, since
# Java's own Unicode mode looks up properties per character and is several times slower.
WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A run of white space; the look-ahead only lets the common characters fail fast.
SPACES = rf"(?![!-~\u00a1-\u167f])[{WHITE}]+"

# One-word contractions that a Treebank-style tokenizer splits in two.
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]

# Unicode categories and joiners that Java's Unicode word class holds.
WORD_CATEGORIES = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc"}
JOINERS = "\u200c\u200d"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only (Unicode white space included)."""
    return ~F.coalesce(_col(c).rlike(f"[^{WHITE}]"), F.lit(False))


def trim_unicode(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def clean_text(c: Column | str) -> Column:
    """Lower-case; drop URLs, mentions, '#', ASCII punctuation and digits; squeeze white space."""
    x = F.lower(_col(c))
    x = F.regexp_replace(x, f"(?:http|www)[^{WHITE}]+", "")
    x = F.regexp_replace(x, r"(?U)@\w+|#", "")
    # marks and digits go one by one, so both deletions are one pass
    x = F.regexp_replace(x, rf"[{PUNCTUATION}\p{{Nd}}]+", "")
    return F.trim(F.regexp_replace(x, SPACES, " "))


def tokenize(c: Column | str) -> Column:
    """Tokens of cleaned text: typographic quotes stand alone, contractions are split."""
    pairs = "|".join(f"({a})({b})" for a, b in CONTRACTIONS)
    first = "".join(f"${2 * i + 1}" for i in range(len(CONTRACTIONS)))
    second = "".join(f"${2 * i + 2}" for i in range(len(CONTRACTIONS)))
    x = F.regexp_replace(_col(c), "[«“‘„»”’]", " $0 ")
    # cleaned text holds no white space but single blanks, so a blank is the word boundary
    x = F.regexp_replace(x, f"(?<![^ ])(?:{pairs})(?![^ ])", f"{first} {second}")
    return F.filter(F.split(x, " "), lambda t: t != "")


def suffix_lemma(token: Column) -> Column:
    """Noun detachment by suffix, the default where the caller brings no lemma table."""
    return (
        F.when(~token.endswith("s") | (F.length(token) < 4), token)
        .when(token.rlike("(?:ss|us|is)$"), token)
        .when(token.rlike("[^aeiou]ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("(?:s|x|z|ch|sh)es$"), F.regexp_replace(token, "es$", ""))
        .otherwise(F.regexp_replace(token, "s$", ""))
    )


def lemmatize(tokens: Column, lemmas: Mapping[str, str] | None = None, suffix_rules: bool = True) -> Column:
    """Map each token by the lemma table, then by suffix. The table is a plan literal.

    The hashed membership test runs first, so the linear map look-up is paid by hits only.
    """
    def one(token: Column) -> Column:
        rest = suffix_lemma(token) if suffix_rules else token
        if not lemmas:
            return rest
        table = F.create_map(*[F.lit(v) for pair in lemmas.items() for v in pair])
        return F.when(token.isin(list(lemmas)), F.element_at(table, token)).otherwise(rest)

    return F.transform(tokens, one)


def preprocess_text(
    c: Column | str,
    stop_words: Sequence[str] = STOP_WORDS,
    lemmas: Mapping[str, str] | None = None,
    suffix_rules: bool = True,
) -> Column:
    """Clean, tokenize, drop stop words (repeats of kept words stay), lemmatize, join by a space."""
    tokens = tokenize(clean_text(c))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(list(stop_words)))
    return F.coalesce(F.array_join(lemmatize(tokens, lemmas, suffix_rules), " "), F.lit(""))


def char_count(c: Column | str) -> Column:
    return F.coalesce(F.length(_col(c)), F.lit(0))


def word_count(c: Column | str) -> Column:
    words = F.filter(F.split(_col(c), SPACES), lambda t: t != "")
    return F.when(_col(c).isNull(), 0).otherwise(F.size(words))


def is_word(entry: str) -> bool:
    """Whether every character is a word character to Java, which splits the texts."""
    return entry != "" and all(unicodedata.category(c) in WORD_CATEGORIES or c in JOINERS for c in entry)


def contains_word(c: Column | str, keywords: Sequence[str]) -> Column:
    """True when any entry occurs as a whole word in the lower-cased text; no entries -> False.

    One-word entries are a hash set that the text's words are looked up in, entries with other
    characters a regex between word boundaries; both mean the same. Empty entries match nothing.
    """
    entries = sorted({k for k in keywords if k})
    plain = [k for k in entries if is_word(k)]
    odd = [k for k in entries if not is_word(k)]
    text = F.lower(_col(c))
    found = F.lit(False)
    if plain:
        found = F.exists(F.split(text, r"(?U)\W+"), lambda t: t.isin(plain))
    if odd:
        found = found | text.rlike(rf"(?U)\b(?:{'|'.join(_quote(k) for k in odd)})\b")
    return F.coalesce(found, F.lit(False))


def _quote(entry: str) -> str:
    """Regex-quote one entry for Java."""
    return re.sub(r"([^\w\s])", r"\\\1", entry)


def contains_part(text: Column, keywords: Sequence[str]) -> Column:
    """True when any entry occurs anywhere, also inside a longer word."""
    found = F.lit(False)
    for entry in keywords:
        found = found | F.contains(text, F.lit(entry))
    return F.coalesce(found, F.lit(False))


def post_type(title: Column | str, body: Column | str, categories: Mapping[str, Sequence[str]], default: str = "Other") -> Column:
    """First category, in the given order, with an entry in title + ' ' + body."""
    text = F.lower(F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(body), F.lit(""))))
    label = None
    for name, keywords in categories.items():
        hit = contains_part(text, keywords)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)


def contains_question(c: Column | str) -> Column:
    return F.coalesce(F.contains(_col(c), F.lit("?")), F.lit(False))
