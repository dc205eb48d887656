"""Text, Markdown and HTML functions on columns; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` takes only blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Words between runs of Unicode white space; no empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def dominant_heading(md: Column) -> Column:
    """``underline`` if two or more lines are underlined, else the shortest run of # that starts two or more lines."""
    out = F.when(F.regexp_count(md, F.lit(r"(?md)^[^\n]+\n-+$")) > 1, F.lit("underline"))
    for level in range(1, 6):
        out = out.when(F.regexp_count(md, F.lit(rf"(?md)^{'#' * level} .*$")) > 1, F.lit("#" * level))
    return out.otherwise(F.lit("#"))


def heading_segments(md: Column, pattern: Column) -> Column:
    """Array of ``(heading, content)``: what stands before the first heading is ``Introduction``, even if empty.

    A # heading's title loses every occurrence of the pattern. No window and no shuffle: pieces and headings of one
    text are zipped in place.
    """
    hashed = F.concat(F.lit("(?md)^"), pattern, F.lit(" .*$"))
    rule = F.when(pattern == "underline", F.lit(r"(?md)^[^\n]+\n-+$")).otherwise(hashed)
    pieces, heads = F.split(md, rule, F.lit(-1)), F.regexp_extract_all(md, rule, F.lit(0))
    title = lambda h: F.when(pattern == "underline", strip(F.regexp_replace(h, r"\n-+$", ""))).otherwise(strip(F.replace(h, pattern, F.lit(""))))
    return F.transform(pieces, lambda p, i: F.struct(F.when(i == 0, F.lit("Introduction")).otherwise(title(F.get(heads, i - 1))).alias("heading"), strip(p).alias("content")))


#: Links in Markdown, and bare ones that don't follow an opening parenthesis.
LINK, BARE = r"\[([^\]]+)\]\((https?://[^\s\)]+)\)", r"(?<!\()(https?://[^\s\)]+)"


def urls(md: Column) -> Column:
    """Distinct URLs of links and bare text, sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(md, F.lit(LINK), F.lit(2)), F.regexp_extract_all(md, F.lit(BARE), F.lit(1)))))


def crawl_urls(md: Column) -> Column:
    """Addresses after ``](``, with ``https://`` put before those without a scheme."""
    found = F.regexp_extract_all(md, F.lit(r"\]\(((?:https?://)?[A-Za-z0-9.-]+\.[a-z]{2,}[^\s\)]*)\)"), F.lit(1))
    return F.transform(found, lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)))


#: An address; autolinks and link texts are left alone.
EMAIL = r"(?<![<\[A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![>\]A-Za-z0-9.-])"


def link_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "<$1>")


def strip_markdown(text: Column) -> Column:
    """Without emphasis characters, links as their text, tags and entities as blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[*_`~]", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(plain, r"<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});", " ")


def html_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), strip(found)).otherwise(F.lit("No title"))


def full_title(html: Column, url: Column) -> Column:
    return F.concat_ws(" - ", html_title(html), F.substring(F.sha2(url, 256), 1, 8))


#: HTML to Markdown, as substitutions in order; a fixed subset that needs no parser.
HTML_RULES = [
    (r"(?is)<!doctype[^>]*>|<!--.*?-->", ""),
    (r"(?is)<(script|style|head)\b.*?</(script|style|head)>", ""),
    (r"(?is)<h1[^>]*>", "\n\n# "), (r"(?is)<h2[^>]*>", "\n\n## "), (r"(?is)<h3[^>]*>", "\n\n### "),
    (r"(?is)</h[1-6]>|<p[^>]*>|</p>|</ul>|<ul[^>]*>", "\n\n"),
    (r"(?is)<li[^>]*>", "\n* "),
    (r"(?is)<br\s*/?>", "  \n"),
    (r"(?is)<(b|strong)(\s[^>]*)?>(.*?)</(b|strong)>", "**$3**"),
    (r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    (r"(?s)<[^>]*>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", "\""), (r"&#39;", "'"), (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
]


def html_to_markdown(html: Column) -> Column:
    out = html
    for pattern, new in HTML_RULES:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def formatted(word: Column, fontname: Column) -> Column:
    """A word with the marks of its font's style."""
    font = F.lower(F.coalesce(fontname, F.lit("")))
    bold, italic = font.rlike("bold|heavy|black"), font.rlike("italic|oblique")
    w = F.when(font.contains("mono"), F.concat(F.lit("`"), word, F.lit("`"))).otherwise(word)
    wrap = lambda m: F.concat(F.lit(m), w, F.lit(m))
    return F.when(bold & italic, wrap("***")).when(bold, wrap("**")).when(italic, wrap("*")).otherwise(w)


def drop_redundant_marks(text: Column) -> Column:
    for old, new in (("** **", " "), ("* *", " "), ("` `", " "), ("\n```\n\n```", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def heading_level(size: Column, body: Column) -> Column:
    ratio = size / body
    return F.when(ratio >= 2, 1).when(ratio >= 1.4, 2).when(ratio >= 1.2, 3)


def indent_level(x0: Column, left: Column) -> Column:
    return F.when(x0 - left < 5, 0).otherwise((F.floor((x0 - left) / 25) + 1).cast("int"))


# What TeX's special characters are written as.
TEX_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_tex(text: Column) -> Column:
    """Special characters escaped in one pass, so that what an escape holds isn't escaped again."""
    table = F.create_map(*[F.lit(x) for kv in TEX_ESCAPES.items() for x in kv])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")


def between_output_tags(text: Column, last: bool = False) -> Column:
    """A reply's part in ``<output>``: between the tags, after a lone opening one, before a lone closing one."""
    if last:
        return F.substring_index(F.substring_index(text, "<output>", -1), "</output>", 1)
    opened, closed = text.contains("<output>"), text.contains("</output>")
    after = F.substring(text, F.instr(text, "<output>") + 8, F.length(text))
    return F.when(opened & closed, F.substring_index(after, "</output>", 1)).when(opened, after).when(closed, F.substring_index(text, "</output>", 1)).otherwise(text)


def fenced(text: Column, language: str) -> Column:
    return strip(F.substring_index(F.substring_index(text, "```" + language, -1), "```", 1))


def visible_key(pandas_series):
    """NFKC and case folding, which no built-in has: for a pandas UDF."""
    import re
    import unicodedata

    def one(v):
        if v is None:
            return None
        for chars, mark in (("\u2070\u00b9\u00b2\u00b3\u2074-\u2079\u207a\u207b", "^"), ("\u2080-\u2089\u208a\u208b", "_")):
            v = re.sub(f"[{chars}]+", lambda m, mark=mark: mark + unicodedata.normalize("NFKC", m[0]), v)
        return re.sub(r"\s+", "", unicodedata.normalize("NFKC", v).replace("\u2212", "-")).casefold()

    return pandas_series.map(one)
