"""String kernels, normalisers and small text predicates as column expressions.

All of them stay in the JVM. Grams and words are arrays, so a kernel is one expression over two columns
and never a row-at-a-time function. Defined results: a null input gives null; two empty texts are equal
(similarity 1); an empty text against another has similarity 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_ascii(text: Column) -> Column:
    """Text with every character outside ASCII replaced by `#`, so that bytes and characters agree."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "#")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def edit_similarity(a: Column, b: Column) -> Column:
    """Share of the longer text that need not be edited."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def wordwise_similarity(a: Column, b: Column) -> Column:
    """Product, over the words of `a`, of the best edit similarity to a word of `b`; both are arrays of words."""
    best = lambda w: F.coalesce(F.array_max(F.transform(b, lambda v: edit_similarity(w, v))), F.lit(0.0))
    return F.aggregate(F.transform(a, best), F.lit(1.0), lambda x, y: x * y)


def bigrams(text: Column) -> Column:
    """Character pairs in order, with repeats; a single character stands for itself."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(pairs)


def bigram_set_similarity(a: Column, b: Column) -> Column:
    """Cosine of the two sets of character pairs."""
    x, y = F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b))
    cosine = F.size(F.array_intersect(x, y)) / F.sqrt((F.size(x) * F.size(y)).cast("double"))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(cosine)


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` (not empty) occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def bigram_kernel(a: Column, b: Column) -> Column:
    """Sum over all pairs of the products of their counts; pairs absent from either add nothing."""
    shared = F.array_intersect(bigrams(a), bigrams(b))
    return F.aggregate(F.transform(shared, lambda g: occurrences(a, g) * occurrences(b, g)), F.lit(0).cast("long"), lambda x, y: x + y)


def normal_kernel(ab: Column, aa: Column, bb: Column) -> Column:
    """K(a, b) / sqrt(K(a, a) K(b, b)); null where a norm is 0."""
    return ab / F.nullif(F.sqrt((aa * bb).cast("double")), F.lit(0.0))


def multiset_dice(a: Column, b: Column) -> Column:
    """Twice the shared multiplicity over both sizes; `a` and `b` are arrays with repeats."""
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    shared = F.aggregate(F.transform(F.array_intersect(a, b), lambda g: F.least(count(a, g), count(b, g))), F.lit(0), lambda x, y: x + y)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * shared / total)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words in lower case, each word padded with two blanks before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def prevailing(literal: Column, fallback: Column, bound: float = 0.85) -> Column:
    """The literal similarity where it is above the bound, else the fallback."""
    return F.when(literal > bound, literal).otherwise(fallback)


def chunks(items: Column, shortest: int = 2) -> Column:
    """All contiguous runs of at least `shortest` items, by start, then by length."""
    n = F.size(items)
    runs = lambda i: F.transform(F.sequence(F.lit(shortest), n - i), lambda k: F.slice(items, i + 1, k))
    return F.when(n < shortest, F.array().cast("array<array<string>>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n - shortest), runs)))


def urlify(text: Column) -> Column:
    """Word characters only, blanks as dashes."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\w\s]", ""), r"\s+", "-")


def concept_key(text: Column) -> Column:
    """Lower case with underscores for blanks, as concepts are written."""
    return F.lower(F.replace(text, F.lit(" "), F.lit("_")))


def has_word(text: Column, *any_of: str) -> Column:
    """Whether one of the words stands in the text as a whole word, in any letter case."""
    return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(any_of)})(?![\p{{L}}\p{{N}}])")


def negated(text: Column) -> Column:
    """Whether a label holds a word of negation."""
    return has_word(text, "not", "no")


def connector(text: Column) -> Column:
    """Kind of a coordinating text: AND (and, but), NEITHER (nor, neither), OR (or), else NONE.

    The first kind in the order NEITHER, OR, AND that has a word in the text.
    """
    return F.when(has_word(text, "neither", "nor"), "NEITHER").when(has_word(text, "or"), "OR").when(has_word(text, "and", "but"), "AND").otherwise("NONE")


def erase_existentials(text: Column) -> Column:
    """`?12` becomes `?`."""
    return F.regexp_replace(text, r"\?[0-9]+", "?")


def innermost_brackets(text: Column) -> Column:
    """Contents of the square brackets that hold no other bracket."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))


def entity_dimension(kind: Column) -> Column:
    """GPE and LOC are SPACE, DATE is TIME, other types stay."""
    return F.when(kind.isin("GPE", "LOC"), "SPACE").when(kind == "DATE", "TIME").otherwise(kind)
