"""Freely typed names mapped to the entries of a canonical list.

One multi-pattern automaton (Aho-Corasick) holds all canonical names and aliases.  It finds every name
that is mentioned in a typed value; the longest mentions that don't overlap win.  What the automaton
can't explain goes to token-set similarity, where tokens may differ by typing errors.  A province, typed
or in the row's own fields, decides between entries of one name.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.functions.text import swap_distance

#: The most entries the list may have; it is sent to every task.
MAX_ENTRIES = 200_000
#: Typed values a task remembers; beyond it starts anew.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Words:
    """The words of a language's names: what abbreviates name words, articles, links, words around a name that
    aren't part of it, words for a province and for other levels."""

    abbreviations: dict[str, str]
    articles: tuple[str, ...]
    links: tuple[str, ...]
    around: tuple[str, ...]
    province: tuple[str, ...]
    other_levels: tuple[str, ...]


#: The words of Spanish names; other languages are given as another ``Words``.
SPANISH = Words(
    abbreviations={
        "sta": "santa", "sto": "santo", "st": "san", "s": "san", "sn": "san", "pto": "puerto", "pt": "puerto", "pta": "punta", "mte": "monte", "mt": "monte",
        "mts": "montes", "fte": "fuente", "fnte": "fuente", "ftes": "fuentes", "tre": "torre", "trr": "torre", "t": "torre", "f": "fuente", "p": "puerto", "m": "monte", "vlle": "valle", "vll": "vall", "va": "villa", "vva": "villanueva", "cast": "castillo",
    },
    articles=("el", "la", "los", "las", "lo", "o", "a", "os", "as", "l", "els", "les", "sa", "es"),
    links=("de", "del", "d", "y", "i", "e", "en", "la", "el", "los", "las"),
    around=("municipio", "mun", "municipality", "ayuntamiento", "ayto", "aytmo", "ajuntament", "concello", "concejo", "termino", "municipal", "villa", "ciudad", "pueblo", "localidad", "centro", "alrededores", "afueras", "cercanias", "entorno", "zona", "area", "casco", "urbano", "norte", "sur", "este", "oeste", "capital", "y", "de", "del", "en", "the", "of", "city", "town", "spain", "espana"),
    province=("provincia", "prov", "provincial", "province"),
    other_levels=("provincia", "prov", "comarca", "mancomunidad", "mancom", "territorio", "isla", "region", "comunidad", "diputacion"),
)


def repaired(text: str) -> str:
    """``text`` without the damage of UTF-8 that was read as a one-byte encoding."""
    if "Ã" in text or "Â" in text:
        for encoding in ("cp1252", "latin-1"):
            try:
                return text.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
    return text


def plain(text: str) -> str:
    """Lower case without accents; all but letters and digits as single blanks; ``/`` and brackets kept as tokens."""
    flat = unicodedata.normalize("NFKD", repaired(text)).casefold()
    out = []
    for c in flat:
        if unicodedata.combining(c) or c in "'’´`":
            continue
        out.append(c if c.isalnum() else f" {c} " if c in "/()," else " ")
    return " ".join("".join(out).split())


def words(text: str, of: Words = SPANISH) -> list[str]:
    """The words of a plain text, without its marks, abbreviations written out."""
    return [of.abbreviations.get(w, w) for w in text.split() if w not in ("/", "(", ")", ",")]


@dataclass
class Entry:
    """An entry of the list: its code, level and province, and its name's forms."""

    code: str
    name: str
    level: str
    province: str
    forms: set[str] = field(default_factory=set)


def forms_of(name: str, of: Words = SPANISH) -> set[str]:
    """How a name may be written in full: both orders of a double name, each half, the article first, last or left out."""
    halves = [" ".join(words(h, of)) for h in plain(name).split("/")]
    halves = [h for h in halves if h]
    out = set(halves) | {" ".join(halves), " ".join(reversed(halves))}
    for h in halves:
        first, _, rest = h.partition(" ")
        if rest and first in of.articles:
            out |= {f"{rest} {first}", rest}
    return out


@dataclass
class Meant:
    """What a typed value means: the codes it may mean, how it was found, how near it is, provinces named with it."""

    codes: tuple[str, ...] = ()
    step: str = "none"
    score: float = 0.0
    provinces: frozenset = frozenset()


class Gazetteer:
    """The list with its automaton and its index of words."""

    def __init__(self, entries: Sequence[tuple[str, str, str]], target: str = "Municipio", province_level: str = "Provincia", of: Words = SPANISH) -> None:
        import ahocorasick

        self.target, self.province_level, self.of = target, province_level, of
        self.entries = [Entry(code, name, level, code[4:6], forms_of(name, of)) for name, code, level in dict.fromkeys(entries)]
        self.by_form: dict[str, list[Entry]] = defaultdict(list)
        self.names_of: dict[str, set[str]] = defaultdict(set)
        for e in self.entries:
            self.names_of[e.code].add(" ".join(words(plain(e.name), of)))
            for f in e.forms:
                self.by_form[f].append(e)
        self.automaton = ahocorasick.Automaton()
        for f in self.by_form:
            self.automaton.add_word(f" {f} ", f)
        if self.by_form:
            self.automaton.make_automaton()
        # words that begin several names, which are the ones that get abbreviated
        heads: dict[str, set[str]] = defaultdict(set)
        for f in self.by_form:
            first, _, rest = f.partition(" ")
            if rest and first not in of.articles:
                heads[first].add(rest)
        self.heads = {h for h, rests in heads.items() if len(rests) > 2} | set(of.abbreviations.values())
        # character pairs of each form, for the values the automaton can't explain
        self.forms = sorted(self.by_form)
        self.form_words = [f.split() for f in self.forms]
        self.form_joined = [f.replace(" ", "") for f in self.forms]
        self.pairs: dict[str, list[int]] = defaultdict(list)
        for k, f in enumerate(self.forms):
            for p in self._pairs(f):
                self.pairs[p].append(k)

    @staticmethod
    def _pairs(text: str) -> set[str]:
        joined = f"^{text.replace(' ', '')}$"
        return {joined[i : i + 2] for i in range(len(joined) - 1)}

    def mentions(self, tokens: Sequence[str]) -> list[tuple[int, int, str]]:
        """The longest names in ``tokens`` that don't overlap, as (first word, last word + 1, form), in order."""
        if not tokens or not self.by_form:
            return []
        text = f" {' '.join(tokens)} "
        starts, at = {}, 0
        for k, w in enumerate(tokens):
            starts[at] = k
            at += len(w) + 1
        hits = []
        for end, f in self.automaton.iter(text):
            k = starts[end - len(f) - 1]
            hits.append((k, k + f.count(" ") + 1, f))
        chosen: list[tuple[int, int, str]] = []
        for hit in sorted(hits, key=lambda h: (h[0] - h[1], -len(h[2]), h[0])):
            if all(hit[1] <= c[0] or hit[0] >= c[1] for c in chosen):
                chosen.append(hit)
        return sorted(chosen)

    def near(self, tokens: Sequence[str]) -> list[tuple[float, str]]:
        """Forms like ``tokens`` by token-set similarity, best first."""
        text = " ".join(tokens)
        shared: dict[int, int] = defaultdict(int)
        own = self._pairs(text)
        for p in own:
            for k in self.pairs.get(p, ()):
                shared[k] += 1
        least, joined = len(own) / 3, "".join(tokens)
        out = []
        for k, n in shared.items():
            if n >= least:
                s = similarity(tokens, self.form_words[k], self.of, joined, self.form_joined[k])
                if s > 0:
                    out.append((s, self.forms[k]))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def _abbreviated(self, tokens: Sequence[str]) -> list[tuple[float, str]]:
        """Names whose first word is short for one of ``heads``, mistyped perhaps: the first word counts little, the rest decides."""
        if len(tokens) < 2 or len(tokens[0]) > 5 or tokens[0] in self.heads:
            return []
        rest = [w for k, w in enumerate(tokens[1:]) if k or w not in self.of.links and len(w) > 2]
        out = []
        for s, f in self.near_rest(rest):
            head = f.split()[0]
            keys = [head, *(k for k, v in self.of.abbreviations.items() if v == head)]
            fit = max(1 - swap_distance(tokens[0], k, 6) / max(len(tokens[0]), len(k)) for k in keys)
            out.append((s - 0.05 * (1 - fit), f))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def near_rest(self, rest: Sequence[str]) -> list[tuple[float, str]]:
        """Forms that begin with one of ``heads`` and go on like ``rest``."""
        if sum(map(len, rest)) < 5:
            return []
        own = self._pairs(" ".join(rest))
        shared: dict[int, int] = defaultdict(int)
        for p in own:
            for k in self.pairs.get(p, ()):
                shared[k] += 1
        out = []
        for k, n in shared.items():
            head, *tail = self.form_words[k]
            if head in self.heads and tail and n * 3 >= len(own):
                s = similarity(rest, [w for w in tail if w not in self.of.links] or tail, self.of)
                if s:
                    out.append((s, self.forms[k]))
        return out

    def municipal(self, form: str) -> list[Entry]:
        return [e for e in self.by_form[form] if e.level == self.target]

    def provinces_named(self, form: str) -> set[str]:
        return {e.province if e.province != "00" else e.code[2:4] for e in self.by_form[form] if e.level == self.province_level}

    def read(self, value: str) -> Meant:
        """What ``value`` means, without the row's other fields."""
        text = plain(value)
        tokens = words(text, self.of)
        if not any(any(c.isalpha() for c in w) for w in tokens):
            return Meant()
        found = self.mentions(tokens)
        covered = {k for a, b, _ in found for k in range(a, b)}
        rest = [w for k, w in enumerate(tokens) if k not in covered and w not in self.of.around]
        if found and not [w for w in rest if w not in self.of.province]:
            return self._of_mentions(tokens, found, "mention", 1.0)
        return self._of_similar(tokens, rest, found)

    def _of_mentions(self, tokens: Sequence[str], found: Sequence[tuple[int, int, str]], step: str, score: float) -> Meant:
        provinces: set[str] = set()
        names: list[str] = []
        for k, (a, _, f) in enumerate(found):
            before = next((w for w in reversed(tokens[:a]) if w not in self.of.links), "")
            if before in self.of.province and self.provinces_named(f):
                provinces |= self.provinces_named(f)
            elif k and self.provinces_named(f) and names:
                # after a municipality, a province's name is where that lies, unless both halves of a double name are typed
                both = {e.code for e in self.municipal(f)} & {e.code for n in names for e in self.municipal(n)}
                if both:
                    names.append(f)
                else:
                    provinces |= self.provinces_named(f)
            elif self.municipal(f):
                names.append(f)
            else:
                provinces |= self.provinces_named(f)
        if not names:
            return Meant((), "other level", score, frozenset(provinces))
        sets = [{e.code for e in self.municipal(n)} for n in names]
        shared = set.intersection(*sets)
        codes = shared or sets[0]
        return Meant(tuple(sorted(codes)), step, score, frozenset(provinces))

    def _of_similar(self, tokens: Sequence[str], rest: Sequence[str], found: Sequence[tuple[int, int, str]]) -> Meant:
        kept = list(tokens)
        full = self.near(tokens)
        while kept and kept[0] in self.of.around and kept[0] not in self.of.articles:
            kept.pop(0)
        while kept and kept[-1] in self.of.around and kept[-1] not in self.of.articles:
            kept.pop()
        kept = kept or list(tokens)
        provinces: set[str] = set()
        best = full if full and kept == list(tokens) else sorted({*full, *self.near(kept)}, key=lambda x: (-x[0], x[1]))
        best = best or self._abbreviated(kept)
        # the last name may be the province the place lies in, the first words the place
        for a, b, f in found[-1:]:
            if a and b == len(tokens) and self.provinces_named(f):
                head = [w for w in tokens[:a] if w not in self.of.around] or list(tokens[:a])
                other = self.near(head) or self._abbreviated(head)
                if other and (not best or other[0][0] > best[0][0]):
                    best, provinces = other, self.provinces_named(f)
        if not best:
            return Meant((), "none", 0.0, frozenset(provinces))
        top = best[0][0]
        ties = [f for s, f in best if s > top - 1e-9]
        if kept[0] in self.of.other_levels:
            return Meant((), "other level", top, frozenset(provinces))
        codes = {e.code for f in ties for e in self.municipal(f)}
        if not codes:
            return Meant((), "other level", top, frozenset(provinces))
        if len(set().union(*(self.names_of[c] for c in codes))) > 1:
            return Meant((), "ambiguous", top, frozenset(provinces))
        return Meant(tuple(sorted(codes)), "similar", top, frozenset(provinces))


#: Typing errors allowed by a word's length: up to (length, errors).
ERRORS = ((4, 0), (7, 1), (12, 2), (10**9, 3))
#: Least similarity of a name.
LEAST_SIMILAR = 0.74


_ALLOWED = [next(e for n, e in ERRORS if size <= n) for size in range(64)]


def allowed(size: int) -> int:
    return _ALLOWED[min(size, 63)]


def similarity(a: Sequence[str], b: Sequence[str], of: Words = SPANISH, joined: str | None = None, other: str | None = None) -> float:
    """Token-set similarity in [0, 1]: characters of words that have a partner, less their typing errors; 0 if too unlike.

    Words are compared in any order and link words count little.  The words of each side put together are one
    more token, so that a blank more or less costs one error.
    """
    joined, other = "".join(a) if joined is None else joined, "".join(b) if other is None else other
    best = 0.0
    if len(a) > 1 or len(b) > 1:
        free, size, lost, total = list(b), 0, 0.0, len(joined) + len(other)
        for w in sorted(a, key=len, reverse=True):
            partner, least = None, 99
            for x in free:
                most = allowed(max(len(w), len(x)))
                d = swap_distance(w, x, most)
                if d <= most and (d < least or d == least and x < partner):
                    partner, least = x, d
            size += len(w)
            if partner is not None:
                free.remove(partner)
                lost += least
            else:
                lost += len(w) * (0.2 if w in of.links or w in of.articles else 1)
                if lost > (1 - LEAST_SIMILAR) * total:
                    break
        else:
            for x in free:
                size += len(x)
                lost += len(x) * (0.2 if x in of.links or x in of.articles else 1)
            best = 1 - lost / max(size, 1)
    most = allowed(max(len(joined), len(other)))
    whole = swap_distance(joined, other, most)
    if whole <= most:
        best = max(best, 1 - whole / max(len(joined), len(other), 1))
    return best if best >= LEAST_SIMILAR else 0.0


def match_names(
    df: DataFrame,
    key: str,
    name: str,
    reference: DataFrame,
    *,
    reference_name: str = "nameunit",
    reference_code: str = "natcode",
    reference_level: str = "natlevname",
    target: str = "Municipio",
    province_codes: str | None = None,
    area_code: str | None = None,
    of: Words = SPANISH,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """``(key, code, step, score)`` for each row whose ``name`` is neither null nor blank.

    ``code`` is that of the entry of level ``target`` meant, ``''`` if none is: then ``step`` says why
    (``none``, ``other level``, ``ambiguous``).  Of several entries of a name, the row's ``province_codes``,
    the province typed with the name and the row's ``area_code`` decide, in this order; if they don't,
    the row is ambiguous.  ``of``: the words of the names' language.  The list is sent to every task, so
    ``max_entries`` bounds it; a longer one raises ``ValueError``.  Rows sent again have their own rows, other columns are ignored, an empty list
    matches nothing, texts of any length are read whole.  Narrow: no shuffle, so no value can be too frequent.
    """
    wanted = reference.select(F.col(reference_name).cast("string"), F.col(reference_code).cast("string"), F.col(reference_level).cast("string")).dropna().distinct()
    listed = wanted.limit(max_entries + 1).collect()
    if len(listed) > max_entries:
        raise ValueError(f"the list has more than {max_entries} entries; raise max_entries if the tasks' memory allows it")
    entries = sorted(tuple(r) for r in listed)

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Gazetteer(entries, target, of=of)
        known: dict[str, Meant] = {}
        for batch in batches:
            out = []
            for typed, codes, own in zip(batch["_name"], batch["_provinces"], batch["_area"]):
                if typed not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[typed] = places.read(typed)
                out.append(decided(known[typed], codes, own))
            yield pd.DataFrame({key: batch[key], "code": [o[0] for o in out], "step": [o[1] for o in out], "score": [o[2] for o in out]})

    rows = df.where(F.col(name).rlike(r"[^\s\u00A0\u200B\uFEFF]")).select(
        F.col(key),
        F.col(name).alias("_name"),
        (F.col(province_codes) if province_codes else F.lit(None)).cast("array<int>").alias("_provinces"),
        (F.col(area_code) if area_code else F.lit(None)).cast("string").alias("_area"),
    )
    return rows.mapInPandas(matched, f"`{key}` {df.schema[key].dataType.simpleString()}, code string, step string, score double")


def decided(meant: Meant, provinces: Sequence[int] | None, area: str | None) -> tuple[str, str, float]:
    """The one code of ``meant`` that the row's own fields leave."""
    codes = meant.codes
    if not codes:
        return "", meant.step, meant.score
    asked = {f"{int(p):02d}" for p in provinces if p == p} if provinces is not None else set()
    for wanted in (asked, meant.provinces):
        fitting = tuple(c for c in codes if c[4:6] in wanted)
        if len(codes) > 1 and fitting:
            codes = fitting
    if len(codes) > 1 and area:
        codes = tuple(c for c in codes if c[-5:] == area.strip()) or codes
    return (codes[0], meant.step, meant.score) if len(codes) == 1 else ("", "ambiguous", meant.score)
