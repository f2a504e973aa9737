"""Several values packed in one text field: a parsing expression grammar over whole columns.

The grammar, with ordered alternatives::

    field     <- item (delimiter+ item)*
    item      <- quoted / bracketed / missing / bare
    quoted    <- '"' ([^"] / '""')* '"' &end / "'" [^']* "'" &end   # backtracks if the quote isn't closed
    bracketed <- open (string / bracketed / !close .)* close &end   # a list in the list: parsed as a field itself
    missing   <- 'n/a' &end                                         # holds a delimiter, so it comes before bare
    bare      <- (aside / !delimiter .)+                            # backtracks to here if a bracket isn't closed
    aside     <- '(' [^()]* ')'                                     # behind a word: "grade (2;3)" is one value
    end       <- blank* (delimiter / !.)

A Java regular expression tries its alternatives in order and backtracks, which is exactly the
grammar's semantics; it runs inside the JVM, without Python and without a shuffle.  Lists may be nested
``NESTED`` deep.  Repetitions are possessive, so that neither time nor stack grows beyond the text's length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that part values.
DELIMITERS = ";,|/+\\t\\n\\r"
#: Words that stand for a missing value (compared in lower case).
PLACEHOLDERS = ("n/a", "na", "none", "null", "nan", "nil", "-", "--", "?", "unknown", "missing", "undefined", "tbd", "no data", "sin dato", "sin datos", "n.a.", "n.d.", "nd", ".", "...", "*")

#: What opens and closes a list.
BRACKETS = ("[]", "{}", "()", "<>")
#: How deep lists may lie in lists.
NESTED = 3

_BLANK = r"[\s\u00A0\u200B\uFEFF]"
_END = rf"(?={_BLANK}*+(?:[{DELIMITERS}]|$))"
_QUOTED = r"""(?:"(?:[^"]++|"")*+"|'[^']*+')"""


def _list(pair: str, deep: int) -> str:
    """A bracketed list in which lists of the same kind lie up to ``deep`` deep."""
    o, c = (f"\\{x}" for x in pair)
    inner = rf"|{_list(pair, deep - 1)}" if deep > 1 else ""
    return rf'{o}(?:"[^"]*+"|[^{o}{c}"]++{inner}|")*+{c}'


_BRACKETED = "(?:" + "|".join(_list(p, NESTED) for p in BRACKETS) + ")"
_BARE = rf"(?:[^{DELIMITERS}(]++|(?<=[^\s{DELIMITERS}(]\s?)\([^()]*+\)|\()++"
_ITEM = rf"(?i){_BLANK}*+(?:{_QUOTED}|{_BRACKETED}|n/a){_END}|{_BARE}"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+$", "")


def _opened(tokens: Column) -> Column:
    """``tokens`` with those of each bracketed list in its place."""
    opened = lambda t: F.regexp_extract_all(F.regexp_replace(_strip(t), r"^.|.$", ""), F.lit(_ITEM), F.lit(0))
    return F.flatten(F.transform(tokens, lambda t: F.when(_strip(t).rlike(f"^{_BRACKETED}$"), opened(t)).otherwise(F.array(t))))


def parse_packed(text: Column, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """``array<struct<pos int, item string, malformed boolean>>`` of the values in ``text``.

    ``pos`` counts from 1 over the values that are not empty; placeholders are no values.  An item has
    no blanks, quotes or brackets around it; a doubled quote inside quotes is one.  ``malformed``: a quote or bracket of the item isn't closed
    (the item is then what is left without the stray mark).  Null and blank texts give an empty array.
    """
    tokens = F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))
    nested = tokens
    for _ in range(NESTED):
        nested = _opened(nested)
    tokens = F.when(text.rlike(r"[\[{(<]"), nested).otherwise(tokens)

    def item(token: Column) -> Column:
        bare = _strip(token)
        quoted = bare.rlike(rf"^{_QUOTED}$")
        plain = _strip(F.regexp_replace(bare, r"""^["'\[\{\(]+|["'\]\}\)]+$""", ""))
        inner = F.replace(_strip(F.regexp_replace(bare, r"""^["']|["']$""", "")), F.lit('""'), F.lit('"'))
        balanced = F.length(F.regexp_replace(bare, r"[^(]", "")) == F.length(F.regexp_replace(bare, r"[^)]", ""))
        # "grade (2)" keeps its own, closed bracket
        kept = F.when(quoted, inner).when(balanced & bare.rlike(r"\w\)$"), bare).otherwise(plain)
        return F.struct(kept.alias("item"), (~quoted & (kept != bare)).alias("malformed"))

    items = F.filter(F.transform(tokens, item), lambda x: (x["item"] != "") & ~F.lower(x["item"]).isin(*placeholders))
    numbered = F.transform(items, lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x["item"].alias("item"), x["malformed"].alias("malformed")))
    return F.coalesce(numbered, F.array().cast("array<struct<pos:int,item:string,malformed:boolean>>"))


def split_packed(df: DataFrame, key: str, fields: Sequence[str], *, least: int = 1, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """One row ``(key, field_name, pos, item, malformed)`` for each value in ``fields`` of ``df``.

    ``least``: only fields holding at least so many values.  Null keys are kept; null, empty and blank
    fields give no row; repeated rows and repeated values give their rows each; any other columns of
    ``df``, whatever their names, are ignored; an empty table gives an empty table.  Narrow: no shuffle.
    """
    text = {f: F.col(f).cast("string") for f in fields}
    if least > 1:  # two values need a delimiter between them, so a text without one isn't parsed
        text = {f: F.when(t.rlike(f"[{DELIMITERS}]"), t) for f, t in text.items()}
    parsed = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(t.isNotNull(), parse_packed(t, placeholders)).alias("values")) for f, t in text.items()])
    return (
        df.select(F.col(key).alias("key"), F.explode(parsed).alias("f"))
        .where(F.size("f.values") >= least)
        .select("key", F.col("f.field_name").alias("field_name"), F.explode("f.values").alias("v"))
        .select(F.col("key").alias(key), "field_name", "v.pos", "v.item", "v.malformed")
    )
