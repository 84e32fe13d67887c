"""Text expressions: tokens, stop words, text assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal, per language; other languages have none.
STOPWORDS = {
    "en": (
        "a an and are as at be but by for from has have he in is it its of on or she that the "
        "their they this to was were will with you your i we us our"
    ).split(),
    "da": (
        "af alle andet at blev blive bliver da de dem den denne der deres det dette dig din "
        "disse dog du efter eller en end er et for fra ham han hans har havde have hende hendes "
        "her hos hun hvad hvis hvor i ikke ind jeg jer kunne man mange med meget men mig min "
        "mine mit ned noget nogle nu når og også om op os over på selv sig sin sine sit skal "
        "skulle som sådan der til ud under var ved vi vil ville vor være været"
    ).split(),
}


def tokens(text: Column, lang: str | None = "en", min_length: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscore, without short ones and stop words; null gives [].

    Repeated tokens are kept. An unknown language, or None, has no stop words.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_]{{{min_length},}}"), F.lit(0))
    stop = STOPWORDS.get(lang, [])
    if not stop:
        return found
    words = F.array(*[F.lit(w) for w in stop])
    return F.filter(found, lambda t: ~F.array_contains(words, t))


def field_tokens(*fields: Column, lang: str | None = "en", min_length: int = 2) -> Column:
    """Tokens of several fields in one bag, unweighted."""
    return F.concat(*[tokens(f, lang, min_length) for f in fields])


def join_fields(*fields: str, separator: str = " ") -> Column:
    """Fields with a separator between them, null as empty."""
    return F.concat_ws(separator, *[F.coalesce(F.col(f), F.lit("")) for f in fields])
