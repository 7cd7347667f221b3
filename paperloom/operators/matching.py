"""Whether a found work is the document that is looked for: yes-or-no rules on its title and its authors, as Columns.

Names are looked for in text without its spaces, since spaces get lost where text is taken from pages; a name of initials
needs the words. All rules are on folded text: lower case, accents gone, a-z and 0-9 alone."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters in which authors are looked for, and a title; letters between a given name and a family name.
HEAD, FIRST_PAGE, BETWEEN = 6000, 3000, 4
#: Fixed value: a line that heads a list of references.
REFERENCES = r"(?i)\n\s*(?:[0-9]+\.?\s*)?(?:references|bibliography|literature cited)\s*\n"


#: Bytes that folded text keeps; the others are spaces.
KEPT = bytes(x if 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def _fold(s: str | None) -> str:
    s = s or ""
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        for x in filter(unicodedata.combining, set(s)):
            s = s.replace(x, "")
    return b" ".join(s.lower().encode("ascii", "replace").translate(KEPT).split()).decode()


@F.pandas_udf(StringType())
def _folded(c: pd.Series) -> pd.Series:
    return c.map(_fold)


def folded(c: Column) -> Column:
    """Words of a-z and 0-9."""
    return _folded(c)


def squashed(fold: Column) -> Column:
    """The letters of folded text alone."""
    return F.regexp_replace(fold, "[^a-z]+", "")


def first_page(text: Column) -> Column:
    """The start of a text, up to a list of references."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, FIRST_PAGE)
    return F.element_at(F.split(head, REFERENCES, 2), 1)


def main_title(title: Column) -> Column:
    return F.element_at(F.split(F.coalesce(title, F.lit("")), ":", 2), 1)


def title_keys(title: Column) -> Column:
    """What titles are compared by, made once a row: folded whole, without its subtitle, and squashed."""
    return F.struct(folded(title).alias("all"), folded(main_title(title)).alias("main"), squashed(folded(title)).alias("letters"))


def page_letters(front: Column) -> Column:
    return squashed(folded(first_page(front)))


def keys_fit(own: Column, page: Column, of: Column) -> Column:
    """title_fits() of two title_keys() and page_letters(), for pairs of rows."""
    same = (own["all"] == of["all"]) | (own["main"] == of["all"]) | (own["all"] == of["main"])
    return (own["all"] != "") & (of["all"] != "") & (same | F.contains(page, of["letters"]))


def title_fits(title: Column, front: Column, w_title: Column) -> Column:
    """Both titles are one, or one is the other without its subtitle, or the work's is printed on the first page."""
    return keys_fit(title_keys(title), page_letters(front), title_keys(w_title))


def is_group(name: Column) -> Column:
    """One word without a comma."""
    return ~F.contains(F.trim(name), F.lit(" ")) & ~F.contains(name, F.lit(","))


def parts(name: Column) -> tuple[Column, Column]:
    """Given and family name, squashed, of `Given Family` or `Family, Given`."""
    comma = F.split(name, ",", 2)
    words = F.split(F.trim(name), r"\s+")
    turned = F.contains(name, F.lit(","))
    given = F.when(turned, F.element_at(comma, -1)).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    family = F.when(turned, F.element_at(comma, 1)).otherwise(F.element_at(words, -1))
    return squashed(folded(given)), squashed(folded(family))


def name_keys(name: Column) -> Column:
    """What a name is looked for by, made once a row."""
    given, family = parts(name)
    return F.struct(is_group(name).alias("group"), given.alias("given"), family.alias("family"), squashed(folded(name)).alias("token"))


def keys_named(key: Column, head: Column, spaced: Column) -> Column:
    """named() of name_keys(), for pairs of rows: patterns are tried only where their letters are there."""
    given, family, token = key["given"], key["family"], key["token"]
    full = F.contains(head, family) & F.contains(head, given) & F.rlike(head, F.concat(given, F.lit(f"[a-z]{{0,{BETWEEN}}}"), family))
    pattern = F.concat(F.lit("(^|[^a-z])"), F.substring(given, 1, 1), F.lit("( [a-z]){0,2} "), family, F.lit("[a-z]?([^a-z]|$)"))
    short = (F.length(family) >= 3) & F.contains(spaced, F.concat(F.lit(" "), family)) & F.rlike(spaced, pattern)
    person = (F.length(family) >= 2) & (given != "") & (full | short)
    return F.coalesce(F.when(key["group"], (F.length(token) >= 4) & F.contains(head, token)).otherwise(person), F.lit(False))


def named(name: Column, head: Column, spaced: Column) -> Column:
    """Whether an author is printed: head is squashed text, spaced folded text without digits.

    A group's name has four letters or more; of a person, given and family name with at most BETWEEN letters between, or the
    initial, at most two more, and a family name of three letters or more, which a letter may follow."""
    return keys_named(name_keys(name), head, spaced)


def spaced(text: Column) -> Column:
    """Folded text with a space for each run of digits, in which names of initials are looked for."""
    return F.regexp_replace(folded(text), "[0-9]+", " ")


def authors_fit(first: Column, others_named: Column, n_authors: Column, head: Column, words: Column, first_alone: bool = False) -> Column:
    """The first author is printed, and a second one too, unless there is no other or the first is a group."""
    ok = (head != "") & named(first, head, words)
    return ok if first_alone else with_others(ok, is_group(first), others_named, n_authors)


def with_others(first_ok: Column, group: Column, others_named: Column, n_authors: Column) -> Column:
    return first_ok & ((n_authors == 1) | group | others_named)


def verified(title_ok: Column, authors_ok: Column, first_ok: Column, by: Column) -> Column:
    """by: how the work was found. `title`, and `doi_in_body`, which may be a reference's, need both rules; `doi` needs one
    of them, and of the authors the first alone."""
    return F.when(by == "doi", title_ok | first_ok).otherwise(title_ok & authors_ok)
