"""Column functions: rounding, hashing, identifiers and text normalisation. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round half towards plus infinity, as ``floor(v * 10^k + 0.5) / 10^k``."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters, in base 36 padded to 7 (texts of the basic plane)."""
    start = F.lit(2166136261)
    h = F.aggregate(
        F.transform(F.split(text, ""), F.ascii),
        start.cast("long"),
        lambda a, c: F.pmod(a.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long"), F.lit(4294967296)),
    )
    return F.lpad(F.lower(F.conv(h.cast("string"), 10, 36)), 7, "0")


def clean_path(path: Column) -> Column:
    """Backslashes to slashes, slashes collapsed, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"), r"^\./", "")


def node_id(prefix: Column, name: Column, file: Column | None = None, signature: Column | None = None) -> Column:
    """``prefix:file:name``, else ``prefix:name:hash(signature)``, else ``prefix:name``."""
    plain = F.concat_ws(":", prefix, F.trim(name))
    if file is not None:
        return F.when(file.isNotNull(), F.concat_ws(":", prefix, clean_path(file), F.trim(name))).otherwise(plain)
    return F.concat_ws(":", prefix, F.trim(name), fnv1a(signature)) if signature is not None else plain


def edge_key(kind: Column, src: Column, dst: Column) -> Column:
    """A display id; edges are keyed by the triple itself, which cannot collide."""
    return F.concat_ws(":", F.lit("edge"), F.lower(kind), fnv1a(F.concat_ws("|", kind, src, dst)))


def split_words(name: Column) -> Column:
    """Spaces at camel-case and acronym boundaries."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def normal_text(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(split_words(text)), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct words of the normalised text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal_text(text), " "), lambda t: t != "")))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words."""
    steps = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
    pairs = F.transform(steps, lambda i: F.concat_ws(" ", F.element_at(words, i), F.get(words, i)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def singular(word: Column) -> Column:
    """-ies to -y, -sses to -ss, one other final s off words of more than three letters."""
    return (
        F.when(word.endswith("ies") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.endswith("sses"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def plural(word: Column) -> Column:
    """-y to -ies on words of more than two letters; a final s stays; else an s more."""
    return (
        F.when(word.endswith("y") & (F.length(word) > 2), F.regexp_replace(word, "y$", "ies"))
        .when(word.endswith("s"), word)
        .otherwise(F.concat(word, F.lit("s")))
    )


def _plain_letters() -> tuple[str, str]:
    """Letters with marks, and the ASCII letter that each has beneath them."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    marked = [(x, y) for x, y in pairs if x != y and y.isascii() and y.isalpha() and len(unicodedata.normalize("NFKC", x)) == 1]
    return "".join(x for x, _ in marked), "".join(y for _, y in marked)


def fold(text: Column) -> Column:
    """Lower case, accents off Latin letters, nothing but ASCII letters and digits left."""
    bare = F.regexp_replace(F.translate(text, *_plain_letters()), "\\p{Mn}", "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]", "")


def file_stem(path: Column) -> Column:
    """The last segment of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), "\\.[^.]+$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def title_case(text: Column) -> Column:
    """A capital at the start of each word; the other letters as they are."""
    return F.array_join(F.transform(F.split(text, "(?<=\\W)(?=\\w)"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def kebab_case(text: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2"), F.lit("_"), F.lit("-")))


def shorten(text: Column, limit: int, marker: str = "...[truncated]") -> Column:
    """White space collapsed; what is longer than ``limit`` is cut there and marked."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit(marker))).otherwise(flat)


def clean_set(values: Column) -> Column:
    """Trimmed, distinct, not empty, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")))


def without_suffix(words: Column, suffixes: tuple[str, ...]) -> Column:
    """Words without the framework suffixes at their end; one word always stays."""
    last = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
        F.lit(1),
        lambda keep, i: F.when(F.coalesce(F.get(words, i - 1), F.lit("")).isin(*suffixes), keep).otherwise(i),
    )
    return F.slice(words, 1, last)


SUFFIXES = ("controller", "service", "module", "provider", "repository", "guard", "middleware", "resolver", "handler")


def variants(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """A name's words joined by a space, by nothing, by ``-`` and by ``_``, and without framework suffixes."""
    words = F.filter(F.split(normal_text(name), " "), lambda w: w != "")
    short = without_suffix(words, suffixes)
    return clean_set(F.array(*[F.array_join(words, by) for by in (" ", "", "-", "_")], *[F.array_join(short, by) for by in (" ", "")]))


def compact(name: Column) -> Column:
    """The singular words of a name in one."""
    return F.array_join(F.transform(F.split(normal_text(name), " "), singular), "")


def commit_category(subject: Column) -> Column:
    """bugfix, refactor, feature or other; the first family that occurs wins."""
    s = F.lower(subject)
    return (
        F.when(s.rlike(r"\b(fix|bug|hotfix|patch|regression)\b"), "bugfix")
        .when(s.rlike(r"\b(refactor|cleanup|clean|rename|move|simplify)\b"), "refactor")
        .when(s.rlike(r"\b(feat|feature|add|implement|introduce|support)\b"), "feature")
        .otherwise("other")
    )


def blast_radius(count: Column) -> Column:
    return F.when(count >= 100, "large").when(count >= 25, "medium").when(count > 0, "small").otherwise("none")
