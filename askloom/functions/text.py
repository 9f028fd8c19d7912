"""Text functions on string columns. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the wide sense: (?U) makes \s cover the no-break space and its
# relatives, the separators 1C-1F are listed.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
# The same characters one by one, for trimming without a pattern (fixed values).
_BLANK_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_WORD = r"([\p{L}\p{N}]+)"

# Marks where markup stood, so text nodes can be told apart after it is gone.
_NODE_MARK = "\u0001"
# Stands for a "<" that is text.
_TEXT_MARK = "\u0004"

# One alternation, so the leftmost construct wins: a comment may hold a script
# tag, and a script may hold a closing paragraph tag in a string.
_MARKUP = (
    r"(?is)<!--(?:.*?-->|.*\z)"
    r"|<(script|style|template)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*+>|.*\z)"
    r"|<[!?][^>]*+>"
    r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</?[a-z][^>]*+>"
)

# HTML names that are references even without a semicolon, longest first.
_BARE_NAMES = "|".join(
    sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
)
_REFERENCE = rf"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_BARE_NAMES}))"

# Every named reference as one literal, which the optimizer folds to a map.
_NAME_TABLE = "\u0002".join(f"{name}\u0003{char}" for name, char in sorted(html5.items()))

# Numeric references to the C1 range mean Windows-1252 characters in HTML.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_C1_MEANT = "".join(
    bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)
)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(_BLANK_CHARS))


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Apply ``use`` to a value that is computed once, however often ``use``
    refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """Split on white space; no empty words."""
    return F.filter(F.split(text, _BLANKS), lambda word: word != "")


def lower_text(text: Column) -> Column:
    return F.lower(text)


def squeeze_space(text: Column) -> Column:
    """White-space runs become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def drop_stopwords(text: Column, stop_words: Iterable[str]) -> Column:
    """Drop words equal (case included) to a stop word, rejoin with one blank."""
    listed = list(stop_words)
    if not listed:
        return F.array_join(words(text), " ")
    return F.array_join(F.filter(words(text), lambda word: ~word.isin(listed)), " ")


def simple_tokens(text: Column) -> Column:
    """Lower-case letter-and-digit runs; null gives no tokens."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(_WORD), 1)


def _code_point(ref: Column) -> Column:
    """``#65;`` or ``#x41;`` to its character."""
    body = F.regexp_replace(ref, r"^#|;$", "")
    is_hex = F.lower(F.substring(body, 1, 1)) == "x"
    digits = F.when(is_hex, F.expr("''")).otherwise(body)
    hexed = F.when(is_hex, F.substring(body, 2, 32)).otherwise(F.conv(digits, 10, 16))
    short = F.upper(F.regexp_replace(hexed, "^0+", ""))
    valid = (F.length(short) <= 5) | ((F.length(short) == 6) & short.startswith("10"))
    surrogate = (F.length(short) == 4) & short.rlike("^D[89A-F]")
    usable = valid & ~surrogate & (F.length(short) > 0)
    char = F.decode(
        F.unhex(F.lpad(F.when(usable, short).otherwise(F.lit("FFFD")), 8, "0")), "UTF-32"
    )
    return F.translate(char, _C1, _C1_MEANT)


def unescape_html(text: Column) -> Column:
    """Decode named and numeric character references in one left-to-right pass.

    One pass matters: ``&amp;lt;`` must become ``&lt;``, not ``<``.
    Unknown names stay as they are.
    """
    names = F.str_to_map(F.lit(_NAME_TABLE), F.lit("\u0002"), F.lit("\u0003"))
    between = F.split(text, _REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), 1)
    decoded = F.transform(
        found,
        lambda ref: F.when(ref.startswith("#"), _code_point(ref)).otherwise(
            F.coalesce(F.try_element_at(names, ref), F.concat(F.lit("&"), ref))
        ),
    )
    woven = F.array_join(
        F.zip_with(
            between,
            F.concat(decoded, F.array(F.lit(""))),
            lambda plain, char: F.concat(plain, char),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), woven).otherwise(text)


def _without_markup(html: Column) -> Column:
    """Every construct replaced by a mark, in time linear in the page. After the
    last ``>`` no tag can close, so there a ``<`` is text and is not tried; only a
    comment may still open, and runs to the end."""
    tail = F.substring_index(html, ">", -1)
    head = F.left(html, F.length(html) - F.length(tail))
    text = F.translate(F.substring_index(tail, "<!--", 1), "<", _TEXT_MARK)
    return F.translate(
        F.regexp_replace(F.concat(head, text), _MARKUP, _NODE_MARK), _TEXT_MARK, "<"
    )


def clean_html(html: Column) -> Column:
    """Visible text of a page: text nodes stripped, empty ones dropped, joined
    by one blank. A comment, script or style that isn't closed runs to the end of
    the page. Null gives an empty string."""
    marked = computed_once(or_empty(html), _without_markup)
    nodes = F.transform(F.split(computed_once(marked, unescape_html), _NODE_MARK + "+"), strip)
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def normalize_title(title: Column) -> Column:
    return lower_text(squeeze_space(or_empty(title)))


def normalize_body(body: Column) -> Column:
    return lower_text(clean_html(body))


def prepare_document(title: Column, tags: Column, question: Column, answer: Column) -> Column:
    """The four normalised fields as one struct; no field is null."""
    return F.struct(
        normalize_title(title).alias("title"),
        or_empty(tags).alias("tags"),
        normalize_body(question).alias("question"),
        normalize_body(answer).alias("answer"),
    )


def document_text(title: Column, tags: Column, question: Column, answer: Column) -> Column:
    """Labelled blocks with a blank line between them. Null tags count as
    empty; any other null makes the whole text null."""
    return F.concat(
        F.lit("Title: "), title,
        F.lit("\n\nTags: "), or_empty(tags),
        F.lit("\n\nQuestion: "), question,
        F.lit("\n\nBest Answer: "), answer,
    )


def embedding_text(title: Column, tags: Column, question: Column, answer: Column) -> Column:
    """``Name: value`` lines; empty parts are left out."""
    parts = {"Title": title, "Tag": tags, "Question": question, "Answer": answer}
    lines = [
        F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value))
        for name, value in parts.items()
    ]
    return strip(F.concat_ws("\n", *lines))


def chunk_source_text(title: Column, tags: Column, question: Column, answer: Column) -> Column:
    """One line with all four labels, whether or not a part is empty."""
    return F.concat(
        F.lit("Title: "), or_empty(title),
        F.lit(" Tag: "), or_empty(tags),
        F.lit(" Question: "), or_empty(question),
        F.lit(" Answer: "), or_empty(answer),
    )


def strip_leading_digit(text: Column) -> Column:
    """Remove one digit at the start."""
    return F.regexp_replace(text, "^[0-9]", "")


def letter_signature(word: Column) -> Column:
    """The letters of a word in order; equal for anagrams."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def is_anagram(left: Column, right: Column) -> Column:
    return letter_signature(left) == letter_signature(right)
