"""Text functions of columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of a question that name no entity.
STOP_WORDS = (
    "the this that these those there here what when where which whom whose while with without about into onto over under after before between from your yours mine ours their they them "
    "have having does doing done did will would shall should could must might can may and but for not are was were been being how why who you get got getting make made take taken want need needs "
    "use used using find please long much many more most some any all out off than then also just very too still work working way ways thing things help know tell ask give show look going good best right"
).split()


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def detect_lang(text: Column) -> Column:
    """zh if any CJK character stands in the text, else en."""
    return F.when(text.rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf]"), "zh").otherwise("en")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def hard_split(text: Column, most: int, overlap: int) -> Column:
    """Windows of most * 4 characters that overlap by overlap * 4, stripped; empty ones go."""
    size, step = most * 4, (most - overlap) * 4
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i + 1, F.lit(size)))), lambda x: x != "")


def entity_tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct words of four letters and more, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 4) & ~x.isin(*stop_words)))


def out_of_range_year(text: Column, first: int, last: int) -> Column:
    """The first year of 19xx or 20xx that stands alone outside first to last, else null."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda x: x.cast("int"))
    return F.get(F.filter(years, lambda y: (y < first) | (y > last)), F.lit(0))


def guard_citations(text: Column, allowed: Column, pattern: str) -> Column:
    """The lines whose matches of pattern (one group) are all allowed."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.size(F.array_except(F.regexp_extract_all(x, F.lit(pattern), 1), allowed)) == 0), "\n")


def is_empty_answer(text: Column, marker: str) -> Column:
    """Whether nothing but a marker or a few characters is left after leading bullets."""
    body = F.ltrim(F.coalesce(text, F.lit("")), F.lit("-*• \n\t"))
    return (F.length(body) < 8) | F.contains(F.lower(body), F.lit(marker))


def format_number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def strip_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?s)<reasoning>.*?</reasoning>", ""))


def first_kept(values: Column) -> Column:
    """An array's distinct values in the order in which they first stand."""
    return F.array_distinct(values)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def joined_url(base: Column, link: Column) -> Column:
    """A link as it stands on the page at base: whole, from the host's root, or from the page's folder; without its fragment."""
    root, folder = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^?#]*/)", 1)
    whole = F.when(link.rlike("^[a-zA-Z]+://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link)).when(link.startswith("/"), F.concat(root, link))
    return without_fragment(whole.otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link)))


def course_line(code: Column, title: Column, facts: list[Column]) -> Column:
    """- CODE: the facts that there are; a line without any says so."""
    said = F.concat_ws(", ", F.when(title.isNotNull(), F.concat(F.lit("name="), title)), *facts)
    return F.concat(F.lit("- "), code, F.lit(": "), F.when(said == "", "no offering").otherwise(said))


def total_line(total: Column, listed: Column) -> Column:
    """The heading of a list, which says where it isn't whole; a total under what is listed doesn't count."""
    n = F.greatest(F.coalesce(total, listed), listed).cast("string")
    return F.when(n.cast("long") > listed, F.concat(F.lit("Courses ("), n, F.lit(" in total, listing "), listed.cast("string"), F.lit(" below):"))).otherwise(F.concat(F.lit("Courses ("), n, F.lit(" in total):")))


def linear_tables(text: Column) -> Column:
    """Rows of Markdown tables as cells with commas; separator rows and empty cells go."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$") | ~F.contains(x, F.lit("|")))

    def row(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: ~c.isin("", "--"))
        return F.when(x.rlike(r"^\s*\|"), F.array_join(cells, ", ")).otherwise(x)

    return F.array_join(F.transform(lines, row), "\n")


def abbreviated(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Abbreviations (whole ASCII words) by their full forms."""
    for short, full in pairs:
        text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9]){short}(?![A-Za-z0-9])", full)
    return text


def bare_dates(text: Column) -> Column:
    """Mentions of a month without a year of four digits within 16 characters."""
    return F.filter(F.regexp_extract_all(text, F.lit("(.{0,16}[0-9]{1,2}\\s*月.{0,16})"), 1), lambda x: ~x.rlike("[0-9]{4}"))


def course_code(text: Column) -> Column:
    """The first code of four letters and four digits that no letter or digit touches, in upper case."""
    return F.upper(F.regexp_extract(text, r"(?<![A-Za-z0-9])([A-Za-z]{4}[0-9]{4})(?![A-Za-z0-9])", 1))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and first path segment."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1)), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*/([^/?#]*)", 1)
