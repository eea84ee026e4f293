"""Text of pages, links, chunks and prompts as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from ..operators.columns import as_column


def unescaped(text: Column | str) -> Column:
    """Character references decoded once: HTML 4's names, decimal and hexadecimal numbers.

    A no-break space becomes a space, a number that is no character U+FFFD; a name that is not
    known, or a reference without its semicolon, stays.
    """
    pieces = F.split(as_column(text), "&")
    names = F.create_map(*(F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, " " if name == "nbsp" else chr(code))), F.lit("apos"), F.lit("'"))

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).cast("long")
        real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        number = F.when(code == 160, " ").when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        character = F.when(name.startswith("#"), number).when(name != "", F.try_element_at(names, name))
        return F.when(character.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(character, F.substr(piece, F.length(name) + 2)))

    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.concat(pieces[0], F.array_join(rest, ""))


def html_text(html: Column | str) -> Column:
    """Visible text: scripts, styles and comments out, tags stripped, references decoded,
    stretches without line ends or double spaces trimmed and joined by one space."""
    text = F.regexp_replace(as_column(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    text = unescaped(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", ""))
    parts = F.transform(F.split(text, r"\r\n|\r|\n|  "), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def host(url: Column | str) -> Column:
    return F.regexp_extract(as_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def links(html: Column | str) -> Column:
    """The href values of anchors, in order."""
    return F.regexp_extract_all(as_column(html), F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))


def resolve(link: Column | str, base: Column | str) -> Column:
    """An absolute URL: with a scheme as it is, with // by the base's scheme, with / from the
    base's root, a fragment on the page itself, else beside the base's last path part."""
    link, base = as_column(link), as_column(base)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )


def chunk_array(text: Column | str, size: int = 1000, overlap: int = 100) -> Column:
    """Pieces of at most ``size`` characters, each beginning with the ``overlap`` last of the
    piece before. An empty or null text has none."""
    text, stride = as_column(text), size - overlap
    last = F.ceil(F.greatest(F.char_length(text) - overlap, F.lit(1)) / stride) - 1
    pieces = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substr(text, (i * stride + 1).cast("int"), F.lit(size)))
    return F.when(F.char_length(text) > 0, pieces)


def chunk_at_breaks(text: Column | str, size: int = 1000) -> Column:
    """Pieces of at most ``size`` characters that end at the last paragraph, line or space
    before; a stretch without any is cut at ``size``."""
    pattern = rf"(?s)\G(?:.{{1,{size}}}\z|.{{1,{size - 2}}}\n\n|.{{1,{size - 1}}}\n|.{{1,{size - 1}}} |.{{1,{size}}})"
    return F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(0))


def event_start(stamp: Column | str) -> Column:
    """A time from a date or date and time in ISO form with or without zone; null if neither."""
    raw = as_column(stamp)
    moment = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))
    return moment


def prompt(template: str, context: Column | str, question: Column | str) -> Column:
    """The template with {context} and {question} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), as_column(context)), F.lit("{question}"), as_column(question))
