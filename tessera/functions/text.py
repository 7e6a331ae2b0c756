"""Text normalisers, tokens, n-grams and literal predicates as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"
#: Wording of online, remote and nationwide services, in lower case with е for ё.
ONLINE = r"\b(?:он[\s-]?лайн|online)\b"
REMOTE = r"\b(?:удаленн[а-я]*|удаленк[а-я]*|дистанцион[а-я]*)\b|\b(?:по|через|в)\s+интернет[а-я]*\b"
NATIONWIDE = r"\b(?:по\s+всей|во\s+всей|вся|всей|по)\s+росси[а-я]*\b|\b(?:люб[а-я]*\s+(?:точк[а-я]*|город[а-я]*)|все\s+город[а-я]*)\s+(?:в\s+)?росси[а-я]*\b"
#: Words of the filters' captions, which say nothing about a service.
FILTER_NOISE = ("вид", "услуги", "тип", "рейтинг", "пользователя", "звезды", "и", "выше")


def _nn(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df with more columns, each computed once a row: a one-row generator keeps the optimizer from copying costly
    expressions into every place that uses them."""
    return df.select("*", F.explode(F.array(F.struct(*columns))).alias("__once")).select(*df.columns, "__once.*")


def clean_text(c: Column, max_chars: int | None = None) -> Column:
    """Null is empty; lower case; ё as е; then the prefix."""
    t = F.replace(F.lower(_nn(c)), F.lit("ё"), F.lit("е"))
    return t if max_chars is None else F.substring(t, 1, max_chars)


def prefix_then_lower(c: Column, n: int) -> Column:
    """The prefix is cut before case changes."""
    return F.replace(F.lower(F.substring(_nn(c), 1, n)), F.lit("ё"), F.lit("е"))


def tokens(c: Column, max_chars: int | None = None) -> Column:
    return F.regexp_extract_all(clean_text(c, max_chars), F.lit(TOKEN), F.lit(1))


def normalize_query(c: Column) -> Column:
    return F.concat_ws(" ", tokens(c))


def word_key(c: Column) -> Column:
    """Runs of word characters (letters, digits, underscore of any script) in lower case, joined by spaces."""
    return F.concat_ws(" ", F.regexp_extract_all(clean_text(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(_nn(c), r"[\s ]+", " "))


def compact(c: Column, limit: int = 220) -> Column:
    """For Markdown tables: null as a dash, white space collapsed, cut, pipes escaped."""
    return F.when(c.isNull(), F.lit("—")).otherwise(F.replace(F.substring(collapse(c), 1, limit), F.lit("|"), F.lit("\\|")))


def join_parts(*parts: Column) -> Column:
    """Non-empty parts joined by '. '."""
    return F.concat_ws(". ", *(F.nullif(collapse(p), F.lit("")) for p in parts))


def item_text(title: Column, params: Column, description: Column, chars: int = 600) -> Column:
    return join_parts(title, params, F.substring(_nn(description), 1, chars))


def word_features(tok: Column) -> Column:
    """w:token for each token, then b:left_right for each neighbouring pair."""
    pairs = F.zip_with(F.slice(tok, F.lit(1), F.greatest(F.size(tok) - 1, F.lit(0))), F.slice(tok, F.lit(2), F.greatest(F.size(tok) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    return F.concat(F.transform(tok, lambda x: F.concat(F.lit("w:"), x)), F.when(F.size(tok) > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_grams(tok: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside space-padded words; a word no longer than n gives itself once and nothing longer."""

    def grams(p: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: p.substr(i, F.lit(n)))
        return F.when((F.lit(n) == low) | (F.length(p) > n - 1), each).otherwise(F.array().cast("array<string>"))

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.concat(*(grams(p, n) for n in range(low, high + 1)))

    return F.flatten(F.transform(tok, of))


def nfkc(c: Column) -> Column:
    """NFKC, case folding, ё as е, white space collapsed. No built-in folds case, so this one is a pandas UDF."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).casefold().replace("ё", "е")).strip(), na_action="ignore")

    return F.coalesce(fold(c), F.lit(""))


def length_bin(c: Column) -> Column:
    """Right-closed bins of the length: up to 14, 21, 29, 39, and longer."""
    n = F.length(_nn(c))
    return F.when(n <= 14, 0).when(n <= 21, 1).when(n <= 29, 2).when(n <= 39, 3).otherwise(4).cast("long")


def stratum(text: Column, filters: Column) -> Column:
    empty = F.when(F.length(F.btrim(_nn(filters))) == 0, F.lit("True")).otherwise(F.lit("False"))
    return F.concat(length_bin(text).cast("string"), F.lit("|empty="), empty)


def minimum_rating(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_nn(c), r"Рейтинг пользователя\s+(\d)", 1), F.lit("")).try_cast("int"), F.lit(0))


def contains_literal(text: Column, literal: Column) -> Column:
    """Whether the collapsed text holds the collapsed literal; empty literals are in nothing."""
    q = collapse(F.lower(_nn(literal)))
    return (q != "") & F.contains(collapse(F.lower(_nn(text))), q)


def inner_tokens(tok: Column) -> Column:
    """How many distinct tokens stand between the first and the last: a text that holds the literal has all of these as
    tokens, while the literal's ends may be parts of longer ones."""
    return F.size(F.array_distinct(F.slice(tok, F.lit(2), F.greatest(F.size(tok) - 2, F.lit(0)))))


def coverage(q: Column, t: Column) -> Column:
    """Share of the distinct tokens of q that t has."""
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(F.array_distinct(q)), F.lit(1))


def flags(c: Column) -> list[Column]:
    """online, remote, nationwide: whether the text has such wording. Words of removal ("удаление") don't count as remote."""
    t = clean_text(c)
    return [t.rlike("(?U)" + p).alias(n) for n, p in (("online", ONLINE), ("remote", REMOTE), ("nationwide", NATIONWIDE))]


# Russian Snowball stemming, after the published description of the algorithm.
_VOWELS = "аеиоуыэюя"
#: The algorithm's endings.
_GERUND = (("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"), ("вшись", "вши", "в"))
_ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
_PARTICIPLE = (("ивш", "ывш", "ующ"), ("ем", "нн", "вш", "ющ", "щ"))
_VERB = (
    "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split(),
    "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split(),
)
_NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()


def _cut(word: str, rv: int, free, after_a=()) -> str | None:
    """word without the longest ending in RV; those in after_a must follow а or я, which stay. None: no ending."""
    for e in sorted({*free, *after_a}, key=len, reverse=True):
        at = len(word) - len(e)
        if at >= rv and word.endswith(e) and (e in free or (at - 1 >= rv and word[at - 1] in "ая")):
            return word[:at]
    return None


def stem_russian(word: str) -> str:
    if not re.search("[а-я]", word):
        return word
    rv = next((i + 1 for i, c in enumerate(word) if c in _VOWELS), len(word))
    regions, at = [], 0
    for _ in range(2):
        m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, at)
        at = m.end() if m else len(word)
        regions.append(at)
    got = _cut(word, rv, *_GERUND)
    if got is None:
        for reflexive in ("ся", "сь"):
            if word.endswith(reflexive) and len(word) - 2 >= rv:
                word = word[:-2]
                break
        got = _cut(word, rv, _ADJECTIVE)
        if got is not None:
            got = _cut(got, rv, *_PARTICIPLE) or got
        else:
            got = _cut(word, rv, *_VERB)
            if got is None:
                got = _cut(word, rv, _NOUN)
    word = word if got is None else got
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    got = _cut(word, regions[1], ("ость", "ост"))
    word = word if got is None else got
    for superlative in ("ейше", "ейш"):
        if word.endswith(superlative) and len(word) - len(superlative) >= rv:
            word = word[: -len(superlative)]
            break
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    return word[:-1] if word.endswith("ь") and len(word) - 1 >= rv else word


def stemmed(tok: Column) -> Column:
    """Tokens with their stems, order and repetitions kept. Batched by Arrow; a worker stems each token once."""
    memo: dict = {}

    @F.pandas_udf("array<string>")
    def stems(s: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            if x not in memo:
                if len(memo) > 300_000:
                    memo.clear()
                memo[x] = stem_russian(x)
            return memo[x]

        return s.map(lambda t: [one(x) for x in t], na_action="ignore")

    return stems(tok)


def stem_terms(terms: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """terms with each token's stem: every distinct token is stemmed once, and joined back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: f[term].map(stem_russian)})

    table = terms.select(term).where(F.col(term).isNotNull()).distinct().mapInPandas(run, f"{term} string, {out} string")
    return terms.join(table, term, "left")
