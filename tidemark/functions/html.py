"""Markup to text, as Column expressions: elements out, entities decoded, the main part chosen, structured data read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Named entities that are decoded; & comes last, so that nothing is decoded twice.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "pound": "£", "euro": "€", "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "reg": "®", "trade": "™", "amp": "&",
}
BLOCKS = r"(?is)<(?:br|/?(?:p|div|li|ul|ol|dl|dt|dd|table|tr|section|article|main|header|footer|nav|h[1-6]))\b[^>]*>"
NOISE = r"(?is)<!--.*?-->|<(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)>"


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(x: Column) -> Column:
    """``x`` with ENTITIES and numeric character references as characters; code points that are none stay as they stand."""
    def one(piece: Column, i: Column) -> Column:
        n = F.coalesce(F.regexp_extract(piece, "^([0-9]{1,7});", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(piece, "^[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10).try_cast("int"))
        good = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(i == 0, piece).when(F.coalesce(good, F.lit(False)), F.concat(_code_point(n), F.regexp_replace(piece, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    out = F.array_join(F.transform(F.split(x, "&#"), one), "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(x.contains("&"), out).otherwise(x)


def clean_text(x: Column) -> Column:
    """Text of markup: blocks on lines of their own, other tags gone, entities decoded, blanks single, no empty lines."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, NOISE, " "), BLOCKS, "\n"), "(?s)<[^>]*>", "")
    spaced = F.regexp_replace(F.regexp_replace(decode_entities(plain), "[ \t \r\x0b\x0c]+", " "), " ?\n[ \n]*", "\n")
    return F.trim(spaced, F.lit(" \n"))


def without_element(x: Column, tag: str, class_word: str | None = None) -> Column:
    """Without any ``tag`` element, or those whose class has a word that begins with ``class_word``, with all that is nested in it at any depth.

    The text is split before each opening and closing tag of that name, and one pass over the pieces
    counts how deep they stand. An element that is never closed goes to the end of the text; a closing tag
    without an opening one stays, as does a tag that closes itself. Each element leaves a blank.
    """
    opens, closes, empty = rf"(?is)^<{tag}\b[^>]*>", rf"(?is)^</{tag}\s*>", rf"(?is)^<{tag}\b[^>]*/>"
    begins = opens if class_word is None else rf"""(?is)^<{tag}\b[^>]*\bclass\s*=\s*["'][^"'>]*\b{class_word}[^>]*>"""
    state = lambda depth, out: F.struct(depth.cast("int").alias("depth"), out.alias("out"))

    def step(at: Column, piece: Column) -> Column:
        more = lambda text: F.concat(at.out, F.array(text))
        real = piece.rlike(opens) & ~piece.rlike(empty)
        outside = F.when(real & piece.rlike(begins), state(F.lit(1), more(F.lit(" ")))).otherwise(state(F.lit(0), more(piece)))
        inside = F.when(real, state(at.depth + 1, at.out)).when(~piece.rlike(closes), at)
        inside = inside.when(at.depth > 1, state(at.depth - 1, at.out)).otherwise(state(F.lit(0), more(F.regexp_replace(piece, closes, ""))))
        return F.when(at.depth == 0, outside).otherwise(inside)

    pieces = F.split(x, rf"(?is)(?=<{tag}\b[^>]*>)|(?=</{tag}\s*>)")
    return F.when(x.rlike(rf"(?is)<{tag}\b[^>]*>"), F.aggregate(pieces, state(F.lit(0), F.array().cast("array<string>")), step, lambda at: F.array_join(at.out, ""))).otherwise(x)


#: Where the main part of a page may be, best first.
MAIN = [r"(?is)<main\b[^>]*>(.*)</main>", r"(?is)<article\b[^>]*>(.*)</article>", r"(?is)<div\b[^>]*\bid=\"content\"[^>]*>(.*)</div>", r"(?is)<div\b[^>]*\bclass=\"[^\"]*\bcontent\b[^\"]*\"[^>]*>(.*)</div>", r"(?is)<body\b[^>]*>(.*?)(?:</body>|$)"]


def main_content(x: Column) -> Column:
    """The first of MAIN that the page has and that is not empty, else the page."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(x, p, 1)), F.lit("")) for p in MAIN], x)


def jsonld_product(x: Column) -> Column:
    """(name, sku, brand) of the first Product among a page's JSON-LD objects and their @graph entries; null without one.

    What is no JSON is passed over.
    """
    blocks = F.regexp_extract_all(x, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    objects = F.flatten(F.transform(blocks, lambda b: F.coalesce(
        F.from_json(F.get_json_object(b, "$.@graph"), "array<string>"), F.when(F.trim(b).startswith("["), F.from_json(b, "array<string>")), F.array(b)
    )))
    products = F.filter(objects, lambda o: F.coalesce(F.get_json_object(o, "$.@type").rlike(r'^"?Product"?$|"Product"'), F.lit(False)))
    first = F.get(products, F.lit(0))
    brand = F.coalesce(F.get_json_object(first, "$.brand.name"), F.get_json_object(first, "$.brand"))
    return F.when(F.size(products) > 0, F.struct(F.get_json_object(first, "$.name").alias("name"), F.get_json_object(first, "$.sku").alias("sku"), brand.alias("brand")))
