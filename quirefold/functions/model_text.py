"""Text of vision-language models: transport tokens, roles, embedded images and generated captions taken out, grounded spans read.

Everything is a column expression. A generated caption goes on over the blocks that follow it, which is a recurrence; blocks
are coded as letters and the runs found by one pattern, so the cost is linear and no row is split up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARABIC, BREAK_TAGS, ROLES, canonical_text, let, trimmed, visual_words
from .text import PERSIAN as PERSIAN_LETTERS

# Names of transport, grounding and sequence tokens; roles are in text.py.
TOKENS = (
    "im_start im_end im_continue im_begin_block im_end_block image_start image_end image_pad vision_start vision_end ref det p document "
    "bos eos pad unk endoftext eot_id start_header_id end_header_id m m_end c"
).split()
# What openings mark a generated picture caption, and what goes on from one.
CAPTION = (
    r"(?i)\b(?:(?:the|this|an?)\s+image\b|this\s+is\s+(?:a\s+)?(?:photograph|photo|picture|caption)\b|this\s+is\s+(?:a\s+)?(?:black\s+and\s+white\s+)?(?:line\s+)?drawing\b"
    r"|caption\s+for\s+the\s+image\b|a\s+person\s+is\s+seen\b|you\s+can\s+see\b|the\s+style\s+of\s+(?:the|this)\s+image\b|image\s+(?:displays|depicts|shows|contains|appears|is)\b)"
)
CAPTION_MORE = (
    r"(?i)^\s*(?:in\s+the\s+(?:background|foreground|midground)|behind\s+(?:this|the)|the\s+(?:building|structure|scene|sky|ground|overall|red|vibrant|bright|flowers?|poppies?|roof|clouds?|design|icon)"
    r"|there\s+(?:is|are)|it\s+(?:is|has|appears))\b"
)
CAPTION_FIELD = r"(?i)^(?:fig[:.]\s*[0-9]+[A-Za-z]?\s*)?(?:(?:a|the)\s+)?(?:field|facility)\b"
PERSIAN = "[\u0600-\u06ff]"


def _any(names) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


# The forms that tokens and lines of templates take.
ANGLE_TOKEN = r"<\s*/?\s*[|]\s*[^<>\n|]{1,80}\s*[|](?:\s*>)?"
BARE_TOKEN = rf"(?i)\\?\s*[|]\s*(?:{_any({*TOKENS, *ROLES[:8]})})\s*[|]\s*>?"
ROLE_TOKEN = rf"(?i)<\s*/?\s*[|]?\s*(?:{_any(ROLES)}|pdfmachine)\s*[|]?\s*>"
BROKEN_TOKEN = r"<\s*/?\s*\|[^<>\n]{1,80}>|\|[^|<>\n]{1,80}\|>"
MODIFIER = r"\\modifier\{[^{}]*\}"
ROLE_PREFIX = rf"(?i)^\s*(?:{_any(ROLES)})\s*:\s*"
ROLE_ALONE = rf"(?i)^\s*(?:{_any(ROLES)})\s*:?\s*$"
DEBRIS = r"^[\\|<>/_* -]{1,32}$"
DROPPED_LINE = (
    r"""(?i)^(?:\s*function\s*=\s*["']get_pdf_[^"']+["']\s*/?>?\s*|\s*\[(?:document|question|answer|image|caption)\]\s*|\s*image\s*\[\[\s*[-0-9.,\s]+\]\]\s*|image)$"""
)
DATA_URI = r"(?i)(?:\b(?:assistant|user)\s*:\s*)?data:image/[a-z0-9.+-]+;base64,[a-z0-9+/= \t]+"
BLOCK_TAG = rf"(?i)</?\s*(?:{BREAK_TAGS})\b[^>]*>"
SPAN_TAG = r"(?i)</?\s*span\b[^>]*>"
ESCAPED_MARK = r"^\s*\\[*_`]+\s*"
EMPTY_LINE = r"(?i)^(?:(?:None\s*){2,}|\\[0-9]+)$"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
EDGE = r"(?U)^\s+|\s+$"
FAMILIES = (ANGLE_TOKEN, BARE_TOKEN, ROLE_TOKEN)


def token_count(line: Column) -> Column:
    """How many transport tokens of the three counted families stand in a line."""
    return sum((F.regexp_count(line, F.lit(p)) for p in FAMILIES), F.lit(0))


def dropped(text: Column, pattern: str, sign: Callable[[Column], Column], by: str = "") -> Column:
    """regexp_replace where sign says that the pattern may match: a plain search costs a fraction of the pattern."""
    return let(text, lambda x: F.when(sign(x), F.regexp_replace(x, pattern, by)).otherwise(x))


def has(*parts: str) -> Callable[[Column], Column]:
    """Whether a text has all of these parts."""
    return lambda x: reduce(lambda a, b: a & b, [x.contains(p) for p in parts])


def begins(letters: str) -> Callable[[Column], Column]:
    """Whether a text, blanks taken off, begins with one of these letters."""
    return lambda x: F.substring(x, 1, 1).isin(*letters)


def strip_tokens(line: Column) -> Column:
    """One trimmed line without tokens and role; blank if only debris of a template is left."""

    def without(x: Column) -> Column:
        c = x
        for p in (*FAMILIES, BROKEN_TOKEN):
            c = F.regexp_replace(c, p, "")
        return F.struct(c.alias("c"), token_count(x).alias("n"))

    def tidy(x: Column) -> Column:
        c = dropped(dropped(x["c"], MODIFIER, has("\\modifier{")), ROLE_PREFIX, has(":"))
        return let(F.struct(trimmed(c).alias("c"), x["n"].alias("n")), judged)

    def judged(x: Column) -> Column:
        few = (x["n"] >= 2) & ~x["c"].rlike(PERSIAN) & (F.length(F.regexp_replace(x["c"], r"[^\p{L}\p{N}_]", "")) <= 8)
        role = begins("".join(sorted({k for r in ROLES for k in (r[0], r[0].upper())})))(x["c"]) & x["c"].rlike(ROLE_ALONE)
        return F.when(role | ((F.length(x["c"]) <= 33) & x["c"].rlike(DEBRIS)) | few, F.lit("")).otherwise(x["c"])

    plain = F.struct(line.alias("c"), F.lit(0).alias("n"))
    return let(F.when(line.contains("<") | line.contains("|"), without(line)).otherwise(plain), tidy)


def _line(raw: Column) -> Column:
    def judged(line: Column) -> Column:
        c = trimmed(dropped(strip_tokens(line), ESCAPED_MARK, has("\\")))
        noise = begins("fF[iI")(line) & line.rlike(DROPPED_LINE)
        return F.when(noise, F.lit("")).otherwise(let(c, lambda x: F.when(begins("nN\\")(x) & x.rlike(EMPTY_LINE), F.lit("")).otherwise(x)))

    return let(trimmed(raw), judged)


#: One of these stands in every text that CAPTION matches, in lower case.
CAPTION_SIGNS = ("image", "photo", "picture", "caption", "drawing", "see")


def caption_code(block: Column) -> Column:
    """S: a generated caption by itself; C: goes on from one; B: blank; N: none of these."""
    latin = block.rlike("[A-Za-z]") & ~block.rlike(PERSIAN)

    def own(low: Column) -> Column:
        sign = reduce(lambda a, b: a | b, [low.contains(w) for w in CAPTION_SIGNS])
        words = F.regexp_count(block, F.lit("[A-Za-z]+"))
        return (sign & block.rlike(CAPTION)) | let(visual_words(low), lambda n: ((n >= 4) & (words >= 8)) | ((n >= 3) & block.rlike(CAPTION_FIELD)))

    return F.when(~block.rlike(r"(?U)\S"), "B").when(latin & let(F.lower(block), own), "S").when(latin & block.rlike(CAPTION_MORE), "C").otherwise("N")


def caption_mask(blocks: Column) -> Column:
    """A letter per block: D where it belongs to a caption, else its own code."""
    codes = F.array_join(F.transform(blocks, caption_code), "")
    runs = F.regexp_extract_all(codes, F.lit("(S[SC]*|[^S])"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.startswith("S"), F.repeat(F.lit("D"), F.length(r))).otherwise(r)), "")


def prepared(text: Column) -> Column:
    """Line ends and full-width bars folded, embedded images and layout tags turned into line ends."""
    c = dropped(F.coalesce(text, F.lit("")), "\r\n?", has("\r"), "\n")
    c = dropped(F.replace(c, F.lit("｜"), F.lit("|")), DATA_URI, has(":", "/", ";", ","), "\n")
    return dropped(dropped(c, BLOCK_TAG, has("<"), "\n"), SPAN_TAG, has("<"))


def strip_artifacts(text: Column) -> Column:
    """Text without what the model or its template put in; recognised words stay as they are."""
    joined = F.array_join(F.transform(F.split(prepared(text), LINE_END), _line), "\n")
    blocks = F.transform(F.split(joined, r"\n\s*\n+"), trimmed)
    kept = lambda bs, mask: F.array_join(F.filter(bs, lambda b, i: ~F.substr(mask, i + 1, F.lit(1)).isin("D", "B")), "\n\n")
    out = let(blocks, lambda bs: let(caption_mask(bs), lambda mask: kept(bs, mask)))
    return trimmed(dropped(out, r"\n{3,}", has("\n\n\n"), "\n\n"))


def canonical_model_text(text: Column, compose: bool = True) -> Column:
    """strip_artifacts() in the Persian canonical form."""
    return canonical_text(F.translate(strip_artifacts(text), ARABIC, PERSIAN_LETTERS), compose)


# Marks at the start of a plain response, and the markup that is taken out of it, in order.
EDGE_TOKEN = r"(?:\\?<\|(?:im_start|im_end)\|>|\\?</?im_(?:start|end)>|<\\?/?im_(?:start|end)>)"
BROKEN_HEADER = r"(?is)\A\s*\\?<[/\\|]*im_?start>[^\u0600-\u06ff]{0,256}?\s---(?:\s|$)"
LEADING = rf"(?i)^(?:\s*[*_`#-]*\s*{EDGE_TOKEN}(?:\s*<br\s*/?>)?\s*){{1,4}}"
PLAIN_RULES = (
    (r"(?i)\\?<[/\\|]*im_?(?:start|end)>|<\\?\|[^>]*>", ""),
    (rf"(?i){EDGE_TOKEN}", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?m)^\s*```[^\n]*\s*$", ""),
    (r"(?m)^\s{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^(\s*)[*+][ \t]+", "$1- "),
    (r"\*\*|__", ""),
    (r"(?m)^\s*[*_`]{1,3}\s*$", ""),
    (r"(?m)^\s*\\[*_`]+\s*$", ""),
    (r"\n{3,}", "\n\n"),
)


def plain_response(content: Column) -> Column:
    """An answer without grounding: wrappers and tokens go, markup becomes plain text."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n"), EDGE, "")
    c = F.regexp_replace(F.regexp_replace(c, BROKEN_HEADER, ""), LEADING, "")
    for pattern, by in PLAIN_RULES:
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, EDGE, "")


# A grounded span, its coordinates, and their upper end.
GROUNDED = r"(?s)<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>(.*?)<\|/det\|>"
COORDINATE_MAX = 999.0


def coordinate_boxes(literal: Column) -> Column:
    """Boxes of a list of four numbers or a list of such lists, clamped; null where any of it is no box or has no area."""
    flat = F.translate(F.trim(literal), "()", "[]")
    nested = F.when(flat.rlike(r"^\[\s*\["), flat).otherwise(F.concat(F.lit("["), flat, F.lit("]")))
    boxes = F.from_json(nested, "array<array<double>>")
    inside = F.transform(boxes, lambda b: F.transform(b, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(COORDINATE_MAX), v))))
    good = (F.size(inside) > 0) & F.forall(inside, lambda b: (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v)) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))))
    return F.when(F.coalesce(good, F.lit(False)), inside)


def grounded_spans(content: Column, width: Column, height: Column) -> Column:
    """array<struct<index, text, raw, x1, y1, x2, y2>> in pixels, ordered from the top and, in a line, from the right.

    Spans without text are left out; a span with bad coordinates has null corners. An answer without spans gives an empty array.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(GROUNDED), F.lit(1)).alias("t"), F.regexp_extract_all(content, F.lit(GROUNDED), F.lit(2)).alias("c"))
    edge = lambda b, i, pick, size: pick(F.transform(b, lambda x: x[i])) / COORDINATE_MAX * size

    def one(p: Column, i: Column) -> Column:
        return let(F.struct(F.regexp_replace(p["t"], EDGE, "").alias("raw"), coordinate_boxes(p["c"]).alias("b")), lambda x: told(x["raw"], x["b"], i))

    def told(raw: Column, b: Column, i: Column) -> Column:
        return F.struct(
            i.alias("index"), canonical_text(raw).alias("text"), raw.alias("raw"),
            edge(b, 0, F.array_min, width).alias("x1"), edge(b, 1, F.array_min, height).alias("y1"), edge(b, 2, F.array_max, width).alias("x2"), edge(b, 3, F.array_max, height).alias("y2"),
        )

    spans = F.filter(F.transform(pairs, one), lambda s: s["text"] != "")
    order = lambda s: F.struct(s["y1"].alias("y1"), (-s["x1"]).alias("x"), s["index"].alias("index"), s.alias("s"))
    return F.transform(F.array_sort(F.transform(spans, order)), lambda o: o["s"])


