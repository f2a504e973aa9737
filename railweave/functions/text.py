"""Names: normal forms, slugs, edit distances and administrative codes, as column expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the plain letters they become, position by position.
MARKED = "ÀÁÂÃÄÅĀĂĄÇĆĈĊČĎÈÉÊËĒĔĖĘĚĜĞĠĢĤÌÍÎÏĨĪĬĮİĴĶĹĻĽÑŃŅŇÒÓÔÕÖŌŎŐŔŖŘŚŜŞŠŢŤÙÚÛÜŨŪŬŮŰŲŴÝŶŸŹŻŽàáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýŷÿźżž"
PLAIN = "AAAAAAAAACCCCCDEEEEEEEEEGGGGHIIIIIIIIIJKLLLNNNNOOOOOOOORRRSSSSTTUUUUUUUUUUWYYYZZZaaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


#: The provinces' names by their codes 1 to 52, in all official languages.
PROVINCES = (
    ("Álava", "Araba"), ("Albacete",), ("Alicante", "Alacant"), ("Almería",), ("Ávila",), ("Badajoz",), ("Illes Balears", "Islas Baleares", "Baleares", "Balears"), ("Barcelona",), ("Burgos",), ("Cáceres",),
    ("Cádiz",), ("Castellón", "Castelló"), ("Ciudad Real",), ("Córdoba",), ("A Coruña", "La Coruña", "Coruña"), ("Cuenca",), ("Girona", "Gerona"), ("Granada",), ("Guadalajara",), ("Gipuzkoa", "Guipúzcoa"),
    ("Huelva",), ("Huesca",), ("Jaén",), ("León",), ("Lleida", "Lérida"), ("La Rioja", "Rioja"), ("Lugo",), ("Madrid",), ("Málaga",), ("Murcia",),
    ("Navarra", "Nafarroa"), ("Ourense", "Orense"), ("Asturias", "Asturies"), ("Palencia",), ("Las Palmas",), ("Pontevedra",), ("Salamanca",), ("Santa Cruz de Tenerife", "Tenerife"), ("Cantabria",), ("Segovia",),
    ("Sevilla",), ("Soria",), ("Tarragona",), ("Teruel",), ("Toledo",), ("Valencia", "València"), ("Valladolid",), ("Bizkaia", "Vizcaya"), ("Zamora",), ("Zaragoza",), ("Ceuta",), ("Melilla",),
)


def plain_name(text: str) -> str:
    """``normal_name`` of one text, on the driver."""
    ascii_only = text.translate(str.maketrans(MARKED + "ªº", PLAIN + "ao")).encode("ascii", "ignore").decode()
    return " ".join("".join(c if c.isalnum() else " " for c in ascii_only).split()).lower()


def province_code(province: int | str) -> int:
    """The code 1 to 52 of a province given by code or name; raises ``ValueError`` for others."""
    text = str(province).strip()
    if text.isdigit():
        if 1 <= int(text) <= len(PROVINCES):
            return int(text)
        raise ValueError(f"province codes are 1 to {len(PROVINCES)}, not {text}")
    codes = {plain_name(n): k for k, names in enumerate(PROVINCES, 1) for n in names}
    if plain_name(text) not in codes:
        raise ValueError(f"no province is called {province!r}")
    return codes[plain_name(text)]


def province_named(text: Column) -> Column:
    """``province_code`` as an expression: the code of a province's code or name; null for others."""
    plain = {plain_name(n): k for k, names in enumerate(PROVINCES, 1) for n in names}
    codes = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    number = F.trim(text).try_cast("int")
    return F.coalesce(F.when(number.between(1, len(PROVINCES)), number), F.try_element_at(codes, normal_name(text)))


def normal_name(text: Column) -> Column:
    """Lower case, marks taken off Latin letters, other characters beyond ASCII dropped, the rest single blanks."""
    plain = F.translate(F.translate(text, MARKED, PLAIN), "ªº", "ao")
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.lower(F.trim(F.regexp_replace(ascii_only, r"[^A-Za-z0-9]+", " ")))


def slug(text: Column) -> Column:
    """The normal name joined by ``_``; ``area`` for nothing."""
    name = F.replace(normal_name(text), F.lit(" "), F.lit("_"))
    return F.when(F.coalesce(name, F.lit("")) == "", "area").otherwise(name)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


@lru_cache(maxsize=1 << 16)
def letters(word: str) -> int:
    """The characters of a word as a set of bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def swap_distance(a: str, b: str, most: int) -> int:
    """Edits from ``a`` to ``b``, a swap of neighbours being one and nothing edited twice; ``most + 1`` if more than ``most``."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if n > m:
        a, b, n, m = b, a, m, n
    if m - n > most:
        return most + 1
    # each character that the other lacks costs an edit
    one, two = letters(a), letters(b)
    if (one & ~two).bit_count() > most or (two & ~one).bit_count() > most:
        return most + 1
    # what both begin and end with costs nothing
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    while n > k and a[n - 1] == b[m - 1]:
        n -= 1
        m -= 1
    a, b, n, m = a[k:n], b[k:m], n - k, m - k
    if not n:
        return m
    # only cells within ``most`` of the diagonal can count
    big = most + 1
    older: list[int] = []
    old = [j if j <= most else big for j in range(m + 1)]
    for i in range(1, n + 1):
        x = a[i - 1]
        new = [big] * (m + 1)
        low, high = max(1, i - most), min(m, i + most)
        left = new[low - 1] = i if low == 1 and i <= most else big
        least = left
        for j in range(low, high + 1):
            y = b[j - 1]
            d = old[j - 1] + (x != y)
            if old[j] < d:
                d = old[j] + 1
            if left < d:
                d = left + 1
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and older[j - 2] < d:
                d = older[j - 2] + 1
            new[j] = left = d
            if d < least:
                least = d
        if least > most:
            return big
        older, old = old, new
    return min(old[m], big)


def typo_distance(a: Column, b: Column, most: Column | None = None) -> Column:
    """``swap_distance`` of two columns (``most + 1`` beyond ``most``), in Arrow batches: meant for pairs that cheaper tests have left."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else swap_distance(p, q, int(k)) for p, q, k in zip(x, y, m)], dtype="Int32")

    return distance(a, b, F.coalesce(F.greatest(F.length(a), F.length(b)), F.lit(0)) if most is None else most)


def typo_similarity(a: Column, b: Column) -> Column:
    """1 - typo distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - typo_distance(a, b) / longer)


def name_parts(text: Column) -> Column:
    """The whole normal name and that of each ``/`` part, in order, without repeats and empty ones."""
    parts = F.transform(F.split(text, "/"), normal_name)
    return F.filter(F.array_distinct(F.concat(F.array(normal_name(text)), parts)), lambda p: p != "")


def province_of(natcode: Column) -> Column:
    """The province of an administrative code: of its digits the 5th and 6th (or else 7th and 8th) of eight or more, the first two of five; 1 to 52, else null."""
    digits = F.regexp_replace(natcode, r"\D", "")
    valid = lambda at: F.when(F.substring(digits, at, 2).try_cast("int").between(1, 52), F.substring(digits, at, 2).try_cast("int"))
    return F.when(F.length(digits) >= 8, F.coalesce(valid(5), valid(7))).when(F.length(digits) == 5, valid(1))


def municipality_code(natcode: Column) -> Column:
    """The last five digits of a code of five or more; else null."""
    digits = F.regexp_replace(natcode, r"\D", "")
    return F.when(F.length(digits) >= 5, F.right(digits, F.lit(5)))
