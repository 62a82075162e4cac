"""Text columns of the layout engine: canonical text, tags and roles, quality gates, list markers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arabic letters and digits and their Persian forms.
ARABIC = "يىك٠١٢٣٤٥٦٧٨٩"
PERSIAN = "ییک۰۱۲۳۴۵۶۷۸۹"
# Direction marks and what no blank stands before or after.
BIDI_CONTROLS = "[؜‎‏‪-‮⁦-⁩﻿]"
CLOSERS, OPENERS, STOPS = r"\)\]\}»", r"\(\[\{«", "،؛؟!?.,:"
# Role names, and tags that only lay text out.
ROLES = ("assistant", "user", "system", "client", "tool", "developer", "human", "bot", "用户", "助手", "系统")
BREAK_TAGS = "p|div|section|article|br|ol|ul|li|h[1-6]|table|thead|tbody|tfoot|tr|td|th"
# Words of generated picture captions.
VISUAL_WORDS = tuple(
    "image photograph photo picture scene background foreground midground building structure roof sky cloud clouds truck trucks flower flowers "
    "poppies petals grass foliage fuel pump pumps camera color colors red white blue visible depicts displays appears icon icons flame flames smoke "
    "design designs gesture hand fingers sunlight window windows tank facility hills landscape drawing caption backdrop mountains cliffs vegetation "
    "situated field".split()
)
# The quality gate's limits.
GATE_TEXT, GATE_SPAN, GATE_REPEATS, GATE_SHARE = 960, 120, 8, 0.2
LTR_TOKEN = r"[A-Za-z0-9]+(?:[._:/%+@-][A-Za-z0-9]+)*"


#: What (?U)\\s matches; trimming these takes a fraction of what the pattern takes.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    """text without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


#: Characters that composition may change or join with others.
COMPOSABLE = r"[\u0300-\x{10ffff}]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """Canonical composition, for which Spark has no function; only texts with characters that may change leave the JVM."""
    some = text.rlike(COMPOSABLE)
    return F.coalesce(_nfc(F.when(some, text)), text)


def canonical_text(text: Column, compose: bool = False) -> Column:
    """One form of extracted text: line ends, direction marks, blanks inside lines and at punctuation; null becomes the empty text.

    compose puts canonical composition first; leave it out only inside lambdas, where Arrow functions cannot stand.
    """
    c = F.coalesce(nfc(text) if compose else text, F.lit(""))
    for pattern, by in (
        ("\r\n?", "\n"),
        (BIDI_CONTROLS, ""),
        (r"(?U)[^\S\r\n]+", " "),
        (r"(?m)^ +| +$", ""),
        (r"[ \t]*‌[ \t]*", "‌"),
        (rf"[ \t]+([{STOPS}])", "$1"),
        (rf"([{OPENERS}])[ \t]+", "$1"),
        (rf"[ \t]+([{CLOSERS}])", "$1"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return trimmed(c)


def persian_text(text: Column, compose: bool = True) -> Column:
    return canonical_text(F.translate(text, ARABIC, PERSIAN), compose)


def visual_to_logical(text: Column) -> Column:
    """Right-to-left text stored as seen, put in reading order; left-to-right tokens stay whole."""
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(f"({LTR_TOKEN}|[\\s\\S])"), F.lit(1))), "")


def strip_tags(html: Column) -> Column:
    """Block tags become line ends, other tags go, runs of blank lines shrink."""
    c = F.regexp_replace(html, rf"(?i)</?\s*(?:{BREAK_TAGS})\b[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def strip_role(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?i)^\s*(?:{'|'.join(ROLES)})\s*:\s*", "")


def _one_of(words: tuple[str, ...] | list[str]) -> str:
    """A pattern of these words that asks for each letter once."""
    heads = sorted({w[0] for w in words if w})
    rest = [_one_of([w[1:] for w in words if w[:1] == h]) for h in heads]
    found = "|".join(h + r for h, r in zip(heads, rest, strict=True))
    return "" if not found else f"(?:{found})" + ("?" if "" in words else "") if "" in words or len(heads) > 1 else found


#: A word of VISUAL_WORDS that is a whole run of small letters.
VISUAL_WORD = rf"(?<![a-z])(?=[{''.join(sorted({w[0] for w in VISUAL_WORDS}))}]){_one_of(VISUAL_WORDS)}(?![a-z])"


def visual_words(low: Column) -> Column:
    """visual_score() of a text in lower case."""
    return F.regexp_count(low, F.lit(VISUAL_WORD))


def visual_score(text: Column) -> Column:
    """How many Latin words belong to the vocabulary of picture captions."""
    return visual_words(F.lower(text))


def looks_like_caption(text: Column) -> Column:
    words = F.size(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)))
    strong = text.rlike(r"(?i)\b(?:(?:the|this|an?) image|image (?:displays|depicts|shows|contains|appears|is)|you can see)\b")
    return ~text.rlike("[؀-ۿ]") & (words > 0) & (strong | ((words >= 8) & (visual_score(text) >= 4)))


def most_repeats(text: str | None) -> int:
    """How often the commonest passage of GATE_SPAN characters stands in a text; 0 for texts below GATE_TEXT.

    Passages are hashed by doubling, so memory is a few times the text; the commonest is compared as text.
    """
    if not text or len(text) < GATE_TEXT:
        return 0
    level, span, done, whole = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1), 1, 0, None
    n = len(level) - GATE_SPAN + 1
    mix = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(29))) + b * np.uint64(0xBF58476D1CE4E5B9)
    with np.errstate(over="ignore"):
        while span <= GATE_SPAN:
            if GATE_SPAN & span:
                part = level[done : done + n]
                whole, done = part if whole is None else mix(whole, part), done + span
            level, span = mix(level[:-span], level[span:]) if span * 2 <= GATE_SPAN else level, span * 2
    keys = np.sort(whole)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(starts, n))
    at = np.flatnonzero(whole == keys[starts[counts.argmax()]])
    if len({text[i : i + GATE_SPAN] for i in at.tolist()}) == 1:
        return len(at)
    return max(Counter(text[i : i + GATE_SPAN] for i in range(n)).values())


#: Pickled, so a worker holds the texts of a hundred rows; an Arrow batch has ten thousand, however long they are.
_repeats = F.udf(most_repeats, T.LongType(), useArrow=False)


def passage_repeats(text: Column) -> Column:
    """most_repeats() as a column; short texts don't leave the JVM."""
    return _repeats(F.when(F.length(text) >= GATE_TEXT, text))


def quality_verdict(text: Column, repeats: Column) -> Column:
    """ok, or why a text is refused."""
    bare = F.regexp_replace(text, "<[^>]*>", "")
    joiners, blanks = F.regexp_count(text, F.lit("‌")), F.regexp_count(text, F.lit(" "))
    return (
        F.when(F.regexp_count(bare, F.lit(r"\p{L}")) < 2, "unusable")
        .when(text.rlike(r"\\[A-Za-z_]+>"), "artifact")
        .when(text.rlike(r"(?i)^day\s+\[\[1\]\]") | ((joiners >= 40) & (joiners > blanks * 2)), "damaged")
        .when((repeats >= GATE_REPEATS) & (repeats * GATE_SPAN >= F.length(text) * GATE_SHARE), "repetition")
        .otherwise("ok")
    )


def text_key(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def english_marker(text: Column) -> Column:
    """struct(letter, strong): a list letter with a separator (strong) or a blank (weak) behind it, or null."""
    strong = F.regexp_extract(text, r"^\s*([A-Z])\s*[-–—.:)]\s*\S", 1)
    weak = F.regexp_extract(text, r"^\s*([A-Z])\s+\S", 1)
    return F.when(strong != "", F.struct(strong.alias("letter"), F.lit(True).alias("strong"))).when(weak != "", F.struct(weak.alias("letter"), F.lit(False).alias("strong")))


def hard_start(text: Column) -> Column:
    """Whether a line begins a block: a legal word, a numbered item or a bullet."""
    return (
        text.rlike(r"(?i)^(?:ماده|تبصره|فصل|بخش|بند|chapter|section|article|clause)(?=$|\s|[-–—ـ.:؛،()0-9۰-۹٠-٩])")
        | text.rlike(r"^\s*[\(\[]?[0-9۰-۹٠-٩]+(?:[\)\]]|[-–—ـ.:])\s*")
        | text.rlike(r"^\s*(?:[•●▪◦◾■□*]|[-–—])\s+")
    )
