r"""HTML -> plain text (I20, with I21 folded in), as column expressions.

Rule: for every h1-h6 and p element, in document order of their start tags,
take the text pieces inside it (script, style and template text and comments
excluded), strip each, drop empty ones, and join them with no separator; join
the element texts with a newline.  Void elements never open; an end tag closes
up to the nearest open element of that name and is ignored when none is open; no
closing is implied, so ``<p>a<p>b`` nests and yields "ab" and "b".  A ``<`` that
begins no markup is text; markup that the page's end cuts off is none.
Character references are resolved as in HTML 5.  Rows with a null or empty html are skipped.

A page is cut into tokens by one regular expression (possessive, so its depth
does not grow with the page), and the tokens are folded: the state holds the open
elements and the pieces found.  The fold runs in stretches of ``STRETCH`` tokens,
because each step copies the pieces it holds.  Nothing is shuffled.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

# The elements whose text is kept, those whose text is never
# text, and the HTML void elements.
TEXT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p"]
TEMPLATE = "template"
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr", "basefont", "bgsound", "frame", "keygen",
             "menuitem", "spacer"]

STRETCH = 256
_NAME = r"[a-zA-Z][^\s/>]*+"
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
# comment | script or style with its content | tag | other markup | cut-off markup | text
_TOKEN = "|".join([
    r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))",
    r"(?i:<(script|style)(?=[\s/>])(?![^>]*+(?<=/)>)" + _ATTRIBUTES + r".*?(?:</\1(?=[\s/>])[^>]*+>|\z))",
    "</?[a-zA-Z]" + _ATTRIBUTES,
    "<[!?/][^>]*+>",
    "<[!?/a-zA-Z].*+",
    "(?:[^<]++|<(?![a-zA-Z/!?]))++",
])
_REFERENCE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[^\t\n\f <&#;]{1,32};?)|&|[^&]++"
# what Python's str.strip() strips
_BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_STATE = "struct<open:array<struct<tag:string,slot:int>>,n:int,out:array<struct<slot:int,piece:string>>>"


def _code_point(code: Column) -> Column:
    """The character of a code point as HTML 5 reads references: windows-1252 for
    U+0080-U+009F, U+FFFD for what is no character, nothing for control characters."""
    latin = F.lit("".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)))
    gone = (code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F)
            | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�"))
            .when(code.between(0x80, 0x9F), F.substr(latin, code - 0x7F, F.lit(1)))
            .when(gone, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def _resolved(part: Column) -> Column:
    """A reference's text; a part that is none stays."""
    # a map is searched from its front: short names, the common ones, come first
    names = F.from_json(F.lit(json.dumps(dict(sorted(html5.items(), key=lambda e: len(e[0]))))), "map<string,string>")
    bare = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    digits = F.regexp_extract(part, "^&#[xX]?0*+([0-9a-fA-F]*+)", 1)
    code = F.when(F.length(digits) <= 7, F.when(F.lower(F.substring(part, 3, 1)) == "x", F.conv(digits, 16, 10))
                  .otherwise(digits).cast("int"))
    code = F.when(digits == "", F.lit(0)).otherwise(code)
    known = F.try_element_at(names, F.substring(part, 2, 40))
    begin = F.regexp_extract(part, "^&(" + "|".join(bare) + ")", 1)
    legacy = F.when(begin != "", F.concat(F.try_element_at(names, begin),
                                          part.substr(F.length(begin) + 2, F.length(part))))
    return (F.when(~part.startswith("&") | (part == "&"), part).when(part.rlike("^&#[xX]?[0-9a-fA-F]"), _code_point(code))
            .otherwise(F.coalesce(known, legacy, part)))


def unescape(text: Column) -> Column:
    """``text`` with its character references resolved."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), _resolved)
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def _tokens(html: Column) -> Column:
    """A page's tokens as (kind, value): t text, o start tag, s closed start tag, c end
    tag.  What neither opens, closes nor is text is left out, and so is empty text.
    One pass a field, so that each is evaluated once."""
    raw = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    named = F.transform(raw, lambda t: F.struct(t.alias("raw"), F.when(t.startswith("<"), F.lower(F.regexp_extract(
        t, "^</?(" + _NAME + ")", 1))).otherwise("").alias("name")))
    return F.filter(F.transform(F.transform(named, _kind), lambda t: F.struct(t["kind"].alias("kind"), F.when(
        t["kind"] == "t", F.btrim(unescape(t["raw"]), F.lit(_BLANK))).otherwise(t["name"]).alias("value"))),
        lambda t: t["kind"].isNotNull() & (t["value"] != ""))


def _kind(token: Column) -> Column:
    raw, name = token["raw"], token["name"]
    closed = raw.endswith("/>") & ~raw.rlike(r"""=\s*+[^\s"'>][^\s>]*+>$""")
    kind = (F.when((name == "") & ~raw.rlike("^<[!?/]"), F.lit("t"))
            .when((name == "") | ~raw.endswith(">"), F.lit(None))
            .when(raw.startswith("</"), F.lit("c"))
            .when(name.isin(*VOID_TAGS, "script", "style"), F.lit(None))
            .when(closed, F.lit("s")).otherwise(F.lit("o")))
    return F.struct(kind.alias("kind"), name.alias("name"), raw.alias("raw"))


def _step(state: Column, token: Column) -> Column:
    """One token: what is open, how many text elements began, the pieces found."""
    opened, n, out, value = state["open"], state["n"], state["out"], token["value"]
    is_text = value.isin(*TEXT_TAGS)
    slots = F.filter(opened, lambda e: e["slot"].isNotNull())
    hidden = F.exists(opened, lambda e: e["tag"] == TEMPLATE)
    back = F.array_position(F.reverse(opened["tag"]), value).cast("int")
    element = F.struct(value.alias("tag"), F.when(is_text, n).alias("slot"))
    more = n + F.when(is_text, 1).otherwise(0)

    def made(o, m, pieces):
        return F.struct(o.alias("open"), m.alias("n"), pieces.alias("out")).cast(_STATE)

    return (F.when(token["kind"] == "t", F.when(hidden, state).otherwise(made(opened, n, F.concat(out, F.transform(
                slots, lambda e: F.struct(e["slot"].alias("slot"), value.alias("piece")))))))
            .when(token["kind"] == "o", made(F.array_append(opened, element), more, out))
            .when(token["kind"] == "s", made(opened, more, out))
            .when(back > 0, made(F.slice(opened, F.lit(1), F.size(opened) - back), n, out))
            .otherwise(state))


def _folded(tokens: Column) -> Column:
    """The state after all tokens."""
    none = F.from_json(F.lit('{"open":[],"n":0,"out":[]}'), _STATE)
    stretches = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(STRETCH))).otherwise(
        F.array().cast("array<int>"))

    def stretch(state, at):
        begin = F.struct(state["open"].alias("open"), state["n"].alias("n"), none["out"].alias("out")).cast(_STATE)
        return F.aggregate(F.slice(tokens, at, F.lit(STRETCH)), begin, _step, lambda r: F.struct(
            r["open"].alias("open"), r["n"].alias("n"), F.concat(state["out"], r["out"]).alias("out")).cast(_STATE))

    return F.aggregate(stretches, none, stretch)


def html_to_text(df: DataFrame, id_col: str = "id", html_col: str = "html",
                 out_col: str = "plain") -> DataFrame:
    """(id, html) -> (id, plain); rows with null or empty html are skipped."""
    pages = df.where(F.length(html_col) > 0).select(F.col(id_col), _tokens(F.col(html_col)).alias("_tokens"))
    found = pages.select(id_col, _folded(F.col("_tokens")).alias("_f")).select(id_col, F.col("_f.n").alias("_n"), F.array_sort(
        F.transform("_f.out", lambda x, i: F.struct(x["slot"].alias("slot"), i.alias("i"), x["piece"].alias("piece")))).alias("_p"))
    # element s stands behind s newlines: its first piece brings those since the piece before
    before = lambda i: F.when(i > 0, F.get("_p", i - 1)["slot"]).otherwise(0)
    text = F.array_join(F.transform("_p", lambda x, i: F.concat(
        F.repeat(F.lit("\n"), x["slot"] - before(i)), x["piece"])), "")
    last = F.coalesce(F.get("_p", F.size("_p") - 1)["slot"], F.lit(0))
    return found.select(id_col, F.concat(text, F.repeat(F.lit("\n"), F.col("_n") - 1 - last)).alias(out_col))
