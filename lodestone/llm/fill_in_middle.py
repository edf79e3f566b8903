"""Fill-in-middle by lookaround splitting: a text is cut into units at zero-width boundaries, and its prefix, suffix and middle are dealt anew.

A unit grammar is translated to a regular expression of zero width that looks at the characters on both sides of a place (`boundary`). Spark's
split cuts there and loses nothing: the pieces, side by side, are the text. split gives an empty text one empty piece, so that is handled apart: it has no units.

The cuts and the form come from the digits of SHA-256 of a salt and the doc_id, so that every run deals alike. Everything is column expressions, row by row,
without a shuffle; a row takes memory in proportion to its units (some tens of bytes each, while it is cut).

Defined results: a null text counts as empty; an empty text, or one that holds a marker, stays plain; a null doc_id counts as no digits; repeated rows
and rows that share a doc_id are cut each on their own (equal texts of a doc_id alike); an empty table gives an empty table; only doc_id and text are
looked at, and other columns travel along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"
#: Of a hundred: texts that stay plain, at and above; texts whose suffix comes first, below.
PLAIN_FROM, SPM_BELOW = 90, 20

#: Unit grammars by name. "each": every character of the class is a unit; "runs": units are the longest runs of one class, and of what is in none;
#: "ends": a unit ends with a run of the class.
GRAMMARS: dict[str, tuple[str, list[str]]] = {
    "code_points": ("each", [r"\x{0}-\x{10FFFF}"]),
    "words": ("ends", [r"\x20\x09-\x0D"]),
    "lines": ("ends", [r"\n"]),
    "runs": ("runs", ["A-Za-z", "0-9", r"\x20\x09-\x0D"]),
}


def boundary(kind: str, classes: list[str]) -> str:
    """The places between units, as a regular expression of zero width. Each alternative names the class before a place and the class after it."""
    between = lambda before, after: f"(?<=[{before}])(?=[{after}])"
    if kind == "each":
        return "|".join(dict.fromkeys(x for c in classes for x in (between(r"\x{0}-\x{10FFFF}", c), between(c, r"\x{0}-\x{10FFFF}"))))
    if kind == "ends":
        return "|".join(between(c, f"^{c}") for c in classes)
    if kind == "runs":
        return "|".join(x for c in classes for x in (between(c, f"^{c}"), between(f"^{c}", c)))
    raise ValueError(f"no kind of grammar: {kind}")


def units(text: Column, grammar: str = "code_points") -> Column:
    """The units of a text, in order; none of an empty text or a null."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(*GRAMMARS[grammar]), -1))


def draws(doc_id: Column, salt: str = SALT) -> list[Column]:
    """Four numbers below 2^32 that depend on the salt and the doc_id alone."""
    digits = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _joined(pieces: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, size), "")


def restored(output: Column, form: Column) -> Column:
    """The text that output holds in its form. No marker stands in a text that was cut, and none can overlap another, so the first is the right one."""
    psm, spm = (F.split(F.substring(output, F.lit(len(first) + 1), F.length(output)), f"{second}|{third}", 3) for first, second, third in ((PREFIX, SUFFIX, MIDDLE), (SUFFIX, PREFIX, MIDDLE)))
    part = lambda x, i: F.get(x, F.lit(i))
    return F.when(form == "psm", F.concat(part(psm, 0), part(psm, 2), part(psm, 1))).when(form == "spm", F.concat(part(spm, 1), part(spm, 2), part(spm, 0))).otherwise(output)


def fill_in_middle(docs: DataFrame, grammar: str = "code_points", salt: str = SALT, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns) with _n (units), _form, _output, _restored, and _prefix_units and _middle_units (null if plain). Columns of these names are replaced."""
    names = ["_n", "_form", "_output", "_restored", "_prefix_units", "_middle_units"]
    own = [F.col(f"`{c}`") for c in keep or docs.columns if c not in names]
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.struct(*own).alias("_row"), text.alias("_text"), F.array(*draws(F.col("doc_id"), salt)).alias("_h"), units(text, grammar).alias("_units"))
    n, h = F.size("_units").cast("long"), [F.get("_h", F.lit(i)) for i in range(4)]
    cuts = [h[i] % (n + 1) for i in (0, 1)]
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    form = F.when((F.col("_text") == "") | marked | (h[2] % 100 >= PLAIN_FROM), "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    df = df.select("_row", "_text", "_units", n.alias("_n"), form.alias("_form"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"))
    a, b, is_cut = F.col("_a"), F.col("_b"), F.col("_form") != "plain"
    parts = [_joined("_units", x.cast("int"), size.cast("int")) for x, size in ((F.lit(0), a), (a, b - a), (b, F.col("_n") - b))]
    parts = F.when(is_cut, F.array(*parts))
    df = df.select("_row", "_text", "_n", "_form", "_a", "_b", parts.alias("_parts"))
    prefix, middle, suffix = (F.get("_parts", F.lit(i)) for i in range(3))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm).otherwise(F.col("_text"))
    df = df.select("_row", "_n", "_form", output.alias("_output"), F.when(is_cut, a).alias("_prefix_units"), F.when(is_cut, b - a).alias("_middle_units"))
    return df.select("_row.*", "_n", "_form", "_output", restored(F.col("_output"), F.col("_form")).alias("_restored"), "_prefix_units", "_middle_units")
