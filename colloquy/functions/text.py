"""Column functions over text. All are null-safe and stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import SLASH_COMMANDS, TOKEN, whole_word

_BLANK = r"[\s\p{Z}]"


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, rf"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{_BLANK}+", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats included.

    The text is lowered at once, but for the one letter whose lower case is two characters.
    """
    found = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    return F.when(F.contains(text, F.lit("İ")), F.transform(found(text), F.lower)).otherwise(found(F.lower(text)))


def first_word(text: Column) -> Column:
    """Lower-case token at the start, past white space and one run of / - # * >; null if there is none."""
    bare = F.regexp_replace(text, rf"^{_BLANK}*[/#*>-]*{_BLANK}*", "")
    word = F.lower(F.regexp_extract(bare, f"^{TOKEN}", 0))
    return F.when(word != "", word)


def without(words: Column, stop: Iterable[str]) -> Column:
    """words without the stop words, repeats kept."""
    listed = sorted(set(stop))
    return F.filter(words, lambda w: ~w.isin(*listed)) if listed else words  # becomes a hash set lookup


def slash_commands(text: Column, before: str = r"[\s`]") -> Column:
    """Every /command that stands at the start or after `before`, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?:^|{before})(/[a-z][a-z0-9_:-]*)"), F.lit(1)), F.lower)


def is_slash_command(command: Column, known: Iterable[str] = SLASH_COMMANDS) -> Column:
    return command.isin(*known) | F.contains(command, F.lit(":"))


def whole_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def has_marker(text: Column, alternatives: str, words: Column | None = None) -> Column:
    """Whether any alternative stands in the text as a whole word; those that are plain words are looked up among whole_words(text), if given."""
    plain = alternatives.lower().split("|")
    if words is None or not all(p.isalpha() for p in plain):
        return text.rlike(whole_word(alternatives))
    return F.arrays_overlap(words, F.array(*[F.lit(p) for p in plain]))


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(text, F.lit(p))
    return found


def is_auto_wake(text: Column, prefixes: Iterable[str]) -> Column:
    """Empty text, or text that an automaton's prefix begins."""
    return (F.coalesce(text, F.lit("")) == "") | starts_with_any(text, prefixes)


def is_auto_wake_strict(text: Column, prefixes: Iterable[str]) -> Column:
    """The detector's form: a prefix anywhere in the first 100 characters, past one run of - * > #, or a leading tag."""
    bare = F.regexp_replace(text, rf"^{_BLANK}*[#*>-]*{_BLANK}*", "")
    head, found = F.substring(bare, 1, 100), F.lit(False)
    for p in prefixes:
        found = found | F.contains(head, F.lit(p))
    return (F.coalesce(text, F.lit("")) == "") | text.rlike(rf"^{_BLANK}*<[a-z][a-z0-9-]+>") | found


def first_sentence(text: Column, most: int = 200) -> Column:
    """Up to the first . ! or ? before white space; cut to `most` characters with three dots."""
    one = F.get(F.split(strip(text), r"[.!?][\s\p{Z}]+", 2), F.lit(0))
    cut = F.concat(F.regexp_replace(F.substring(one, 1, most), rf"{_BLANK}+$", ""), F.lit("..."))
    return F.when(F.length(one) > most, cut).otherwise(one)


def slugify(text: Column, most: int = 50) -> Column:
    """Lower-case ASCII letters and digits joined by underscores; 'rule' if there are none."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    cut = F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, most)
    return F.when(cut == "", F.lit("rule")).otherwise(cut)


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_to_text(html: Column) -> Column:
    """Tags out, entities of the five markup characters resolved, white space squeezed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return squeeze(out)


def safe_name(name: Column, most: int = 64) -> Column:
    """Letters, digits, space and . _ ' - only, at most `most` of them; 'user' if nothing is left."""
    kept = F.substring(squeeze(F.regexp_replace(name, r"[^\p{L}\p{N} ._'-]", "")), 1, most)
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit("user")).otherwise(kept)


def quoted_part(text: Column) -> Column:
    """The first 25 to 400 characters in double quotes; null if there are none."""
    found = F.regexp_extract(text, "[\"“]([^\"“”]{25,400})[\"”]", 1)
    return F.when(found != "", found)


def short_project(slug: Column, parts: int = 2) -> Column:
    """The last parts of a dashed path slug."""
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - parts + 1, F.lit(1)), parts), "-")


def labelled_sections(body: Column) -> Column:
    """Map from lower-case label to text for each **Label:** of a rule body; the last of equal labels counts."""
    pattern = r"(?s)\*\*([^*:\n]+):\*\*(.*?)(?=\n?\*\*[^*:\n]+:\*\*|\z)"
    names = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.lower(F.trim(x)))
    texts = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(2)), squeeze)
    pairs = F.arrays_zip(names.alias("k"), texts.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), p["k"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def allowed(items: Column, deny: Iterable[str]) -> Column:
    """Items of an array that contain none of the denied fragments, in lower case between spaces."""

    def clean(x: Column) -> Column:
        padded, bad = F.concat(F.lit(" "), F.lower(x), F.lit(" ")), F.lit(False)
        for d in deny:
            bad = bad | F.contains(padded, F.lit(d))
        return ~bad

    return F.filter(items, clean)
