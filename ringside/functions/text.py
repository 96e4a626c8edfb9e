"""Text expressions: accent folding, slugs, titles, lists. All are plain Column expressions."""
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from ringside import vocab


@lru_cache(maxsize=1)
def _accent_table():
    """Precomposed letters whose canonical decomposition is one base letter plus marks."""
    accented, plain = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(char):
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def fold(text) -> Column:
    """Lower case without accents; null becomes the empty string."""
    accented, plain = _accent_table()
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.translate(text, accented, plain), r"\p{Mn}", "")
    is_ascii = F.octet_length(text) == F.char_length(text)     # most values: skip the table
    return F.coalesce(F.when(is_ascii, F.lower(text)).otherwise(F.lower(bare)), F.lit(""))


def once(value, use) -> Column:
    """use(value), with value computed a single time per row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slug(text, default=None) -> Column:
    """URL segment: folded, runs of anything else than a-z0-9 become one dash, trimmed."""
    dashed = F.regexp_replace(fold(text), "[^a-z0-9]+", "-")
    out = F.regexp_replace(dashed, "^-|-$", "")
    return out if default is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def smart_title(text) -> Column:
    """Re-case a label only when at least 80 % of its letters are upper case."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    shouting = (letters > 0) & (capitals >= letters * F.lit(0.8))

    def recase_word(word, word_no):
        pieces = F.regexp_extract_all(word, F.lit("([-'’]|[^-'’]+)"), F.lit(1))

        def recase_piece(piece, piece_no):
            stays = (word_no > 0) & (piece_no == 0) & piece.isin(*vocab.SMALL_WORDS)
            return F.when(stays, piece).otherwise(
                F.concat(F.upper(F.substring(piece, 1, 1)),
                         piece.substr(F.lit(2), F.length(piece))))
        return F.array_join(F.transform(pieces, recase_piece), "")

    words = F.split(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+")
    recased = F.array_join(F.transform(words, recase_word), " ")
    return F.when(shouting, recased).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


# fixed value: how the census writes the numbered districts of the three largest cities
DISTRICT = r"(?i)^(.+?)\s+\d+(?:er|e|eme|ème)\s+Arrondissement$"


def parent_city(city) -> Column:
    """City a numbered district belongs to, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(city, F.lit("")), DISTRICT, 1), F.lit(""))


def normal_url(url) -> Column:
    """Trim and add a scheme when there is none; null for an empty address."""
    bare = F.trim(url)
    return F.when(F.length(url) > 0, F.when(bare.startswith("http"), bare)
                  .otherwise(F.concat(F.lit("https://"), bare)))


def is_valid_id(ident) -> Column:
    return ident.rlike(vocab.ID_PATTERN)


def natural_list(items, lang="fr") -> Column:
    """"a, b et c"."""
    link = {"fr": " et ", "en": " and "}[lang]
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (F.when(n == 0, F.lit("")).when(n == 1, F.element_at(items, 1))
            .otherwise(F.concat(head, F.lit(link), F.try_element_at(items, F.lit(-1)))))


def label_of(code, labels, default=None) -> Column:
    """Dictionary lookup with a fall-back column (null when none is given)."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), code)
    return found if default is None else F.coalesce(found, default)


def present(text) -> Column:
    """True for a non-empty string."""
    return F.coalesce(F.length(text) > 0, F.lit(False))
