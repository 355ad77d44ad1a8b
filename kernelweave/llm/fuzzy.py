"""Names typed freely, matched to reference names within a bounded edit distance.

Names are folded first: accents, letter case, punctuation and blanks do not count, and the words may
be turned round (`Bakery, X` for `X Bakery`). A reference name is cut into k + 1 segments; if at most k
edits lie between it and a typed name, one segment is untouched and stands in the typed name at most
k places from its own position. Segments are therefore joined by equality with substrings around
these positions, and only the candidates that meet are compared in full. What meets no reference is
found by the anti-join.

Defined results: names of up to 5 folded letters must be equal (initials differ by little), longer ones may have
two edits, as two exchanged letters take; the nearest name wins, and a tie between two entries names none.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.runtime import broadcast_if_small

MOST_EDITS = 2
_ACCENTED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold(name: Column) -> Column:
    """Words of letters and digits in lower case without accents, with single blanks between; spaced initials are one word."""
    bare = F.regexp_replace(F.translate(name, "".join(_ACCENTED), _PLAIN), r"\p{M}+", "")
    words = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, r"(?<=^| )(\p{L}) (?=\p{L}(?: |$))", "$1")


def allowed(name: Column) -> Column:
    """Edits that a folded name may differ by."""
    n = F.length(name)
    return F.when(n <= 5, 0).otherwise(MOST_EDITS)


def _turned(name: Column) -> Column:
    """The name and its rotations by whole words."""
    words = F.split(name, " ")
    turn = lambda k: F.array_join(F.concat(F.slice(words, k + 1, F.size(words)), F.slice(words, 1, k)), " ")
    return F.transform(F.sequence(F.lit(0), F.size(words) - 1), turn)


def _segments(names: DataFrame) -> DataFrame:
    """kind, entry, name, n, seg, piece of every reference name's k + 1 segments."""
    parts = F.lit(MOST_EDITS + 1)
    start = lambda i: F.floor(i * F.col("n") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(MOST_EDITS)), lambda i: F.struct(i.alias("seg"), F.col("name").substr(start(i) + 1, start(i + 1) - start(i)).alias("piece")))
    return names.withColumn("n", F.length("name")).select("kind", "entry", "name", "n", F.inline(cut))


def _pieces(typed: DataFrame) -> DataFrame:
    """kind, typed, turned, n, seg, piece: substrings where a segment of a reference of length n may stand."""
    lengths = typed.withColumn("n", F.explode(F.expr(f"sequence(greatest(1, length(turned) - {MOST_EDITS}), length(turned) + {MOST_EDITS})")))
    segs = lengths.withColumn("seg", F.explode(F.expr(f"sequence(0, {MOST_EDITS})")))
    segs = segs.withColumns({"a": F.expr(f"cast(floor(seg * n / {MOST_EDITS + 1}) as int)"), "b": F.expr(f"cast(floor((seg + 1) * n / {MOST_EDITS + 1}) as int)")})
    shifts = segs.withColumn("at", F.explode(F.expr(f"sequence(a - {MOST_EDITS}, a + {MOST_EDITS})")))
    shifts = shifts.where("at >= 0 AND at + b - a <= length(turned)")
    return shifts.select("kind", "typed", "turned", "n", "seg", F.expr("substring(turned, at + 1, b - a)").alias("piece")).distinct()


def match_names(typed: DataFrame, names: DataFrame) -> DataFrame:
    """item and entry (`none` where none is meant) of every row of `typed` (item, kind, name); `names` has kind, entry, name."""
    rows = typed.select("item", "kind", fold(F.col("name")).alias("typed"))
    refs = names.select("kind", "entry", fold(F.col("name")).alias("name")).where("name <> ''").distinct()
    asked = rows.where("typed <> ''").select("kind", "typed").distinct().withColumn("turned", F.explode(_turned(F.col("typed")))).distinct()
    met = _pieces(asked).join(broadcast_if_small(_segments(refs)), ["kind", "n", "seg", "piece"]).select("kind", "typed", "turned", "entry", "name").distinct()
    near = met.withColumn("edits", F.levenshtein("turned", "name", MOST_EDITS)).where((F.col("edits") >= 0) & (F.col("edits") <= allowed(F.col("name"))))
    best = near.groupBy("kind", "typed", "entry").agg(F.min("edits").alias("edits"))
    best = best.groupBy("kind", "typed").agg(F.min(F.struct("edits", "entry")).alias("low"), F.collect_list(F.struct("edits", "entry")).alias("all"))
    sure = best.where(F.size(F.filter("all", lambda x: x.edits == F.col("low.edits"))) == 1).select("kind", "typed", F.col("low.entry").alias("entry"))
    found = rows.join(sure, ["kind", "typed"]).select("item", "entry")
    return found.unionByName(rows.join(found.select("item"), "item", "left_anti").select("item", F.lit("none").alias("entry")))
