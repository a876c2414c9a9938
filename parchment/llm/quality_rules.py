"""Line-first cleaning: rules per line, then a verdict on the document by the text it would lose. Column functions only.

A null text has no words and no lines. Empty lines (no word) are neither judged nor counted. A text is judged whole,
whatever its length; repeated windows and lines are found within one row, so no row meets another and nothing is
shuffled. Repeated rows come out alike, an empty table gives an empty one. Columns of the input are kept; one that has an
output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import apart, words

SYMBOLS = r"[#*$%&|<>]"
#: What separates the entries of a menu.
SEPARATORS = r"[|»›·•]"
#: What the furniture of a page says, in English, French, German and Spanish: phrases, as prose has each of their words too.
PHRASES = "|".join(
    (
        r"(?:uses?|accept|our|all|manage) cookies|cookie (?:policy|settings|notice|consent)|privacy policy|all rights reserved|terms of (?:use|service)",
        r"(?:sign|log) ?(?:in|up)|subscribe (?:now|today|to our)|(?:enable|requires?) javascript|copyright (?:©|\(c\)|[12][0-9]{3})|lorem ipsum|click here|read more",
        r"(?:utilise|accepte|accepter|gérer) (?:des|les|nos) cookies|politique de confidentialité|tous droits réservés|conditions d['’]utilisation",
        r"mentions légales|connectez-vous|inscrivez-vous|abonnez-vous|cliquez ici|lire la suite",
        r"(?:verwendet|nutzt|akzeptieren|alle) cookies|datenschutzerklärung|alle rechte vorbehalten|nutzungsbedingungen",
        r"jetzt (?:anmelden|registrieren|abonnieren)|hier klicken|hier anmelden|mehr lesen",
        r"(?:utiliza|usa|aceptar|acepta) (?:las )?cookies|política de (?:privacidad|cookies)|todos los derechos reservados|(?:términos|condiciones) de uso",
        r"aviso legal|iniciar sesión|regístrate|suscríbete|haga clic aquí|leer más",
        # notices: given out under a licence, whatever its name, or under one that goes by its letters
        *(
            rf"(?:{verbs}) (?:{under}) .{{0,60}}?(?:{name}|CC[ -]BY[-A-Z0-9. ]*|CC0|[AL]?GPL[-v0-9.]*|MIT|BSD|Creative Commons)|{alone}"
            for verbs, under, name, alone in (
                (r"licen[cs]ed|released|distributed|published|provided|available|shared", "under", r"licen[cs]es?", r"licen[cs]ed (?:under|to you)|spdx-license-identifier"),
                (r"(?:licencié|publié|distribué|diffusé|proposé)e?s?|disponibles?", "sous|selon", "licences?", r"sous (?:la )?licence"),
                (r"lizenziert|veröffentlicht|verfügbar|bereitgestellt|steht|stehen", "unter", r"\p{L}*lizenz(?:en)?", r"lizenziert unter"),
                (r"(?:licenciad|publicad|distribuid|ofrecid)[oa]s?|disponibles?", "bajo", "licencias?", r"bajo (?:la |una )?licencia"),
            )
        ),
    )
)
BOILERPLATE = rf"(?iu)(?<!\p{{L}})(?:{PHRASES})(?!\p{{L}})"
TERMINAL = r"""[.!?…:;,"'»”’)\]][\x20\x09-\x0D]*$"""


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    symbol_share: float = 0.10  # of a line's characters: symbols that prose hardly has
    shout_share: float = 0.05  # of a line's characters: exclamation marks
    separators: int = 3  # of a navigation line, at least
    fragment_chars: int = 30  # a line this short without closing punctuation is a fragment
    boilerplate_chars: int = 200  # a longer line that has such a phrase is prose
    lost_share: float = 0.5  # a document that loses more of its text goes


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def failing(line: Column, rules: LineRules) -> Column:
    """Which rule a line with a word fails: 'punctuation', 'navigation', 'boilerplate', or ''."""
    n = F.length(line)
    punctuation = (
        (_count(line, r"[#*$%&|<>{}\\^~=+@]") > rules.symbol_share * n)
        | (_count(line, "!") > rules.shout_share * n) & F.contains(line, F.lit("!!"))
        | (n <= rules.fragment_chars) & ~line.rlike(TERMINAL)
    )
    return (
        F.when(_count(line, SEPARATORS) >= rules.separators, "navigation")
        .when((n <= rules.boilerplate_chars) & line.rlike(BOILERPLATE), "boilerplate")
        .when(punctuation, "punctuation")
        .otherwise("")
    )


def repeated_words(found: Column, own: Callable[[str], str], size: int = 3) -> list[tuple[str, Column]]:
    """Steps, each a column for the next: the words that lie in windows which the text has twice or more.

    Windows are sorted by hash and place within the row; those with an equal neighbour repeat, and what they cover is
    counted from the gaps between their places. n log n in the text's words.
    """
    hashes = F.when(
        F.size(found) >= size,
        F.transform(F.sequence(F.lit(0), F.size(found) - size), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))
    h, s, p = map(F.col, (own("hashes"), own("sorted"), own("places")))
    ranked = F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    )
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    places = F.sort_array(
        F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | F.when(k > 0, same(x, F.get(s, k - 1))).otherwise(False)), lambda x: x["i"])
    )
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    return [(own("hashes"), hashes), (own("sorted"), ranked), (own("places"), places), (own("repeated"), F.coalesce(covered, F.lit(0).cast("bigint")))]


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned_text", "n_lines_failed", "lost_share")


def clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds the base counts, cleaned_text, n_lines_failed, lost_share (of characters in lines) and kept."""
    keep, own = apart(docs, OUTPUTS)
    said, found, lines, good, joined = map(own, ("said", "words", "lines", "good", "joined"))
    whole = F.coalesce(F.col(text), F.lit(""))
    # the text has its own column here, as it may be one that an output replaces
    df = docs.select(*keep, whole.alias(said)).withColumn(found, words(F.col(said)))
    df = df.withColumn(joined, F.array_join(found, "")).withColumn(lines, F.filter(F.split(said, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(good, F.filter(lines, lambda x: failing(x, rules) == ""))
    for name, step in repeated_words(F.col(found), own):
        df = df.withColumn(name, step)
    n, repeated = F.size(found).cast("bigint"), F.col(own("repeated"))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    lost = F.coalesce(1 - chars(F.col(good)) / F.nullif(chars(F.col(lines)), F.lit(0)), F.lit(0.0))
    failed = (n < 50) | (F.lit(100) * repeated > F.lit(50) * n)
    df = df.select(
        *keep,
        n.alias("n_words"),
        F.length(joined).cast("bigint").alias("word_chars"),
        _count(F.col(joined), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.array_join(good, "\n").alias("cleaned_text"),
        (F.size(lines) - F.size(good)).cast("bigint").alias("n_lines_failed"),
        lost.alias("lost_share"),
    )
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.lost_share))
