"""Splitting, measuring and tokenising text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH

ENDINGS = "。?？!！;；…"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # what (?U)\s matches
_OPENER = "[一-龥A-Za-z0-9(\\[\"']"
_RUNS = r"[a-zA-Z]+\p{Nd}+|\p{Nd}+[a-zA-Z]+|[a-zA-Z]+|\p{Nd}+|[^a-zA-Z\p{Nd}]+"
PALETTE = ("#ffd1dc", "#c1e1c1", "#aec6cf", "#fdfd96", "#ffb347", "#cfcfc4", "#b39eb5", "#77dd77", "#f49ac2", "#9bd3dd")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.btrim(c, F.lit(_SPACE))


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def boundary(endings: str = ENDINGS) -> str:
    """The regular expression between two sentences: after an ending or a dot that is beside no lone letter, before an opener."""
    ends = "".join("\\" + c if c in "\\]^-[&" else c for c in endings)
    after_dot = r"(?<=\.)(?<!\b[A-Za-z]\.)(?![A-Za-z]\b)"
    return rf"(?U)(?:(?<=[{ends}])|{after_dot})\s*(?=\s*{_OPENER})"


def sentences(text: Column | str, endings: str = ENDINGS) -> Column:
    """array<string>: the text cut at sentence boundaries, stripped, without empties. A null gives a null."""
    return _pieces(F.split(_col(text), boundary(endings)))


def comma_pieces(text: Column | str) -> Column:
    """array<string>: cut after commas and semicolons, and at line ends."""
    return _pieces(F.split(F.regexp_replace(_col(text), "([,;，；])", "$1\n"), "\n"))


def space_pieces(text: Column | str, most: int) -> Column:
    """array<string>: words packed greedily into pieces of at most `most` characters, a blank after each word counted.

    A first word longer than that leaves an empty piece before it.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s, w):
        fits = F.length(s["now"]) + F.length(w) + 1 <= most
        done = F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(F.rtrim(s["now"]))))
        return F.struct(done.alias("done"), F.when(fits, F.concat(s["now"], w, F.lit(" "))).otherwise(F.concat(w, F.lit(" "))).alias("now"))

    words = F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")
    return F.aggregate(words, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.rtrim(s["now"])))))


def clean_pdf(text: Column | str) -> Column:
    """Line breaks and blanks of text from a PDF, evened out."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"\n{3,}", "\n"), r"(?U)\s+", " ")


def segments(text: Column | str, most: int = 100, endings: str = ENDINGS, pdf: bool = False) -> Column:
    """array<string>: sentences; those longer than `most` characters cut at commas, and what is still longer at blanks.

    A null gives an empty array.
    """
    text = F.coalesce(_col(text), F.lit(""))
    return F.flatten(F.transform(sentences(clean_pdf(text) if pdf else text, endings), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.flatten(F.transform(comma_pieces(s), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(space_pieces(p, most)))))))


def weighted_length(text: Column | str) -> Column:
    """int: length without white space, where a run of letters counts 0.47, a digit or a letter beside digits 0.01, all else 1; the sum's floor."""
    runs = F.regexp_extract_all(F.regexp_replace(_col(text), r"(?U)\s+", ""), F.lit(_RUNS), F.lit(0))

    def weight(m):
        return F.when(m.rlike("^[a-zA-Z]+$"), F.lit(0.47)).when(m.rlike(r"^[a-zA-Z\p{Nd}]"), F.length(m) * F.lit(0.01)).otherwise(F.length(m).cast("double"))

    return F.floor(F.aggregate(runs, F.lit(0.0), lambda s, m: s + weight(m))).cast("int")


def tokens(text: Column | str, stopwords: tuple[str, ...] = ENGLISH, longer_than: int = 2) -> Column:
    """array<string>: words of more than `longer_than` characters that aren't stopwords, in order, in their case."""
    words = F.regexp_extract_all(_col(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(list(stopwords)) if stopwords else F.length(w) > longer_than)


def query_terms(query: Column | str) -> Column:
    """array<string>: a query's parts between ASCII question marks."""
    return _pieces(F.split(_col(query), r"\?"))


def language(text: Column | str) -> Column:
    """'zh' if a fifth of the letters are Han, 'en' if most are Latin, else null."""
    han, latin, any_ = (F.regexp_count(_col(text), F.lit(p)) for p in (r"\p{IsHan}", r"\p{IsLatin}", r"\p{L}"))
    return F.when((any_ > 0) & (han * 5 >= any_), "zh").when((any_ > 0) & (latin * 2 > any_), "en")


def excerpt(text: Column | str, length: int, key: Column | str, seed: int = 0) -> Column:
    """A stretch of `length` characters at a place drawn by the MD5 of key and seed; a shorter text whole, an empty one null."""
    if length < 1:
        raise ValueError("length must be positive")
    t = _col(text)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", _col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")
    at = F.pmod(drawn, (F.length(t) - length + 1).cast("long"))
    return F.when(F.length(t) > length, F.substring(t, (at + 1).cast("int"), F.lit(length))).when(t != "", t)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\t", "&nbsp;" * 4), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlighted(chunks: Column | str, palette: tuple[str, ...] = PALETTE) -> Column:
    """HTML with each chunk on a colour of its own, by turns."""
    colours = F.array(*map(F.lit, palette))
    span = lambda c, i: F.concat(F.lit('<span style="background-color: '), F.element_at(colours, (i % len(palette) + 1).cast("int")), F.lit('; border-radius: 3px">'), _escaped(c), F.lit("</span>"))
    return F.concat(F.lit('<div style="white-space: pre-wrap">'), F.array_join(F.transform(_col(chunks), span), " "), F.lit("</div>"))


def highlight(chunks: list, palette: tuple[str, ...] = PALETTE) -> str:
    """highlighted() for a few chunks at hand: strings, lists of strings (joined by blanks), or objects with a page_content."""
    import html

    out = []
    for i, c in enumerate(chunks):
        c = getattr(c, "page_content", c)
        c = " ".join(c) if isinstance(c, list) else c
        if not isinstance(c, str):
            raise TypeError(f"a chunk must be a string, a list of strings or have a page_content, not {type(c).__name__}")
        c = html.escape(c).replace("\t", "&nbsp;" * 4).replace("\n", "<br>")
        out.append(f'<span style="background-color: {palette[i % len(palette)]}; border-radius: 3px">{c}</span>')
    return f'<div style="white-space: pre-wrap">{" ".join(out)}</div>'


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """null if a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
