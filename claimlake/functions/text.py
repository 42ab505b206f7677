"""Text functions. White space means Unicode white space and the four ASCII separators, as the claims' sources use it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a class of single characters, and all of it as text: fixed values.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACES}]"
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Placeholders for unset old values and for unknown fields: fixed values.
UNSET, UNKNOWN = "-", "—"


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it occurs in there."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends. A single space inside is left untouched, not replaced by itself."""
    return strip(F.regexp_replace(c, rf" ?[{SPACES}&&[^ ]]{SPACE}*|  {SPACE}*", " "))


def clean_text(c: Column) -> Column:
    """Tidy extracted text: blank lines, spaces, hyphenation at line ends, glued words, line ends. Null gives ''.

    Each pattern starts with a character that is rare in prose, so that the text is passed over quickly. A letter that
    ended one joined hyphenation can't begin the next, which is what ``\\G`` is for.
    """
    out = F.coalesce(c, F.lit(""))
    out = F.when(out.contains("\n\n\n"), F.regexp_replace(out, r"\n{3,}", "\n\n")).otherwise(out)
    out = F.regexp_replace(out, r"\t[ \t]*| [ \t]+", " ")
    out = F.regexp_replace(out, rf"(?U)-(?<=\w-)(?<!\G-){SPACE}*\n{SPACE}*(\w)", "$1")
    out = F.regexp_replace(out, "(?<=[a-zäöüß])[A-ZÄÖÜ]", " $0")
    return strip(F.array_join(F.transform(F.split(out, "\n"), strip), "\n"))


def unfence(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    out = F.regexp_replace(strip(c), r"(?i)^```(?:json)?", "")
    return strip(F.regexp_replace(out, r"```\z", ""))


def parse_json(c: Column) -> Column:
    """Variant of a possibly fenced answer; null if it is no JSON."""
    return F.try_parse_json(unfence(c))


#: The delimiters of a section, with its name: fixed values.
BEGIN, END = r"<!--\s*BEGIN_(\w+)\s*-->", r"<!--\s*END_%s\s*-->"


def sections(c: Column) -> Column:
    """map<name, content> of all delimited sections, names in upper case; of duplicates the last counts.

    A section runs from a delimiter that opens it to the next one that closes the same name; delimiters in between are
    content, and one that is never closed opens nothing (each such one costs a look at the rest of the text).
    """
    whole = F.regexp_extract_all(c, F.lit("(?isU)" + BEGIN + ".*?" + END % r"\1"), F.lit(0))
    name = lambda m: F.upper(F.regexp_extract(m, "(?iU)^" + BEGIN, 1))
    body = lambda m: strip(F.regexp_replace(F.regexp_replace(m, "(?iU)^" + BEGIN, ""), "(?iU)" + END % r"\w+" + r"\z", ""))

    def last(names: Column, bodies: Column) -> Column:
        """Both arrays turned round: the first place of a name is its last section."""
        one = lambda n: F.get(bodies, (F.array_position(names, n) - 1).cast("int"))
        several = bind(F.array_distinct(names), lambda all_: F.map_from_arrays(all_, F.transform(all_, one)))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, bodies)).otherwise(several)

    # what lambdas refer to is bound once, or it would be computed for every element
    found = bind(F.reverse(whole), lambda all_: bind(F.transform(all_, name), lambda names: bind(F.transform(all_, body), lambda bodies: last(names, bodies))))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(c.contains("<!--"), found).when(c.isNotNull(), none)


def section(c: Column, name: str) -> Column:
    """Content of the last section of a name, null without one."""
    return F.try_element_at(sections(c), F.lit(name.upper()))


def first_section(c: Column, name: str) -> Column:
    """Content of the first section of a name, '' without one."""
    rest = F.get(F.split(c, rf"(?iU)<!--\s*BEGIN_{name}\s*-->", 2), F.lit(1))
    parts = F.split(rest, rf"(?iU)<!--\s*END_{name}\s*-->", 2)
    return F.when(F.size(parts) == 2, strip(parts[0])).when(c.isNotNull(), F.lit(""))


def render(template: Column, values: Mapping[str, Column]) -> Column:
    """Fill placeholders one after the other, so that a value may hold a later placeholder."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("None")))
    return template


def unfilled(prompt: Column) -> Column:
    return prompt.contains("{{")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def shorten(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def chunk_line(page: Column, order: Column, kind: Column, content: Column, rows: Column, cols: Column, image_index: Column, width: Column, height: Column) -> Column:
    """One line that shows a chunk."""
    first = F.element_at(F.split(content, "\n"), 1)
    table = F.concat(F.format_string("Table (%dx%d)", rows, cols), F.when(F.length(content) > 0, F.concat(F.lit(" "), first)).otherwise(F.lit("")))
    image = F.concat(F.lit("Image index="), image_index.cast("string"), F.lit(" size="), width.cast("string"), F.lit("x"), height.cast("string"))
    body = F.when(kind == "text", shorten(F.replace(content, F.lit("\n"), F.lit(" ")))).when(kind == "table", shorten(table)).otherwise(image)
    return F.format_string("Page %02d | Order %02d | %-5s | %s", page, order, F.upper(kind), body)


def ledger_cells(line: Column) -> Column:
    """The four trimmed cells of a ledger line, null for any other line. Outer pipes are all stripped first."""
    bare = F.regexp_replace(strip(line), r"^\|+|\|+\z", "")
    cells = F.transform(F.split(bare, r"\|", -1), strip)
    return F.when(line.contains("|") & (F.size(cells) == 4), cells)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(name: Column) -> Column:
    """Lower-case text after the last dot; '' without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
