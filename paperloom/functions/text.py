"""Text and identifier functions, as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least length of a usable title key (fixed value).
TITLE_KEY_CHARS = 30


def normalize_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def title_key(c: Column) -> Column:
    k = normalize_title(c)
    return F.when(F.length(k) >= TITLE_KEY_CHARS, k).otherwise("")


def surname(c: Column) -> Column:
    """What stands before a comma, else the last word, normalised; a missing name is empty."""
    c = F.trim(F.coalesce(c, F.lit("")))
    last = F.element_at(F.split(c, r"\s+"), -1)
    return normalize_title(F.when(F.instr(c, ",") > 0, F.substring_index(c, ",", 1)).otherwise(last))


def doi_key(c: Column) -> Column:
    """Lower case without URL or scheme prefix and final punctuation; null unless it begins 10."""
    k = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:)", ""))
    return F.when(k.startswith("10."), F.regexp_replace(k, "[.,;]+$", ""))


def plain_doi(c: Column) -> Column:
    """As paper keys have it: lower case, without URL or scheme prefix, whatever is left."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(https://doi\.org/)?(http://doi\.org/)?(doi:)?", "")


def paper_keys(doi: Column, title: Column, year: Column | None = None, authors: Column | None = None) -> Column:
    """The keys by which two rows may be one work: DOI, long title, or, for short titles of two records of one version
    server, title, year, surnames and number of authors."""
    d, t = plain_doi(F.coalesce(doi, F.lit(""))), title_key(F.coalesce(title, F.lit("")))
    keys = [F.when(d != "", F.concat(F.lit("doi:"), d)), F.when(t != "", F.concat(F.lit("title:"), t))]
    if year is not None and authors is not None:
        names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), surname), lambda n: n != "")))
        short = normalize_title(F.coalesce(title, F.lit("")))
        made = F.concat(F.lit("zenodo:"), short, F.lit("|"), year.cast("string"), F.lit("|"), F.array_join(names, ","), F.lit("|"), F.size(authors).cast("string"))
        keys.append(F.when((t == "") & d.startswith("10.5281/zenodo.") & (short != "") & (F.size(names) > 0), made))
    return F.array_compact(F.array(*keys))


def bare_id(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.trim(s, F.lit("-")), 1, 80)


def word_array(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the two sets of lower-case words."""
    x, y = F.array_distinct(word_array(F.lower(a))), F.array_distinct(word_array(F.lower(b)))
    u = F.size(F.array_union(x, y))
    return F.when(u > 0, F.size(F.array_intersect(x, y)) / u).otherwise(0.0)


def read_minutes(c: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(F.size(word_array(c)) / 200, 0).cast("int"))


def hue(c: Column) -> Column:
    return F.conv(F.substring(F.sha1(c), 1, 4), 16, 10).cast("int") % 360


def redact(c: Column) -> Column:
    """URL queries dropped, addresses blanked, at most 500 characters, of which a cut text's last is an ellipsis."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"""(https?://[^\s?'"<>]+)\?[^\s'"<>]*""", "$1")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return F.when(F.length(c) <= 500, c).otherwise(F.concat(F.substring(c, 1, 499), F.lit("\u2026")))


def orcid_ok(c: Column) -> Column:
    """ISO 7064 mod 11-2 over 15 digits and the check character."""
    d = F.regexp_replace(c, "[^0-9Xx]", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda s, i: (s + d.substr(i, F.lit(1)).cast("int")) * 2)
    check = (F.lit(12) - total % 11) % 11
    want = F.when(check == 10, F.lit("X")).otherwise(check.cast("string"))
    return (F.length(d) == 16) & (F.upper(d.substr(F.lit(16), F.lit(1))) == want)


def inverted_text(index: Column) -> Column:
    """map<word, positions> -> the text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def chunks(c: Column, target: int, overlap: int) -> Column:
    """Windows of `target` words that share `overlap`; the last may be short. The words are cut once, as a lambda's argument."""
    step = target - overlap
    last = lambda w: F.greatest(F.lit(0), F.ceil((F.size(w) - target) / step)).cast("int")
    cut = lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.array_join(F.slice(w, i * step + 1, target), " "))
    made = F.transform(F.array(word_array(c)), lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.array().cast("array<string>")))
    return F.coalesce(made[0], F.array().cast("array<string>"))


def floor4(c: Column) -> Column:
    return F.floor(c * 10000 + F.lit(1e-9)) / 10000


def bar_floor(c: Column) -> Column:
    return F.floor(c * 1000 + F.lit(1e-9)) / 1000
