"""Groups spelling variants: PartEnum signatures over letter multisets, equi-joined and verified.

Two words that differ by one inserted, deleted or replaced letter have letter multisets that, as binary vectors over
(letter, occurrence), differ in two places at most. Letters are dealt to ``PARTS`` parts; a difference of two spoils two
parts at most, so the vectors agree on all parts but some two of them (partition), and a word has a signature for every
choice of two parts left out (enumerate). One edit also leaves the first or the last three of seven letters or more as
they are, so every signature is completed once by each: words whose multisets are alike only by chance seldom meet. What meets
under a signature is joined and verified by edit distance. All of it is DataFrame code.

The vocabulary is a table: words are counted over all documents, combined before the shuffle. A word's form is its near
word of the largest count, where that is ``FACTOR`` times its own; roots follow forms by doubling, a form's count being at
least ten times larger, so there are few rounds.

Defined results: null and empty texts have no words; null ids hash as an empty id; repeated rows count each. An empty
table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import parts_for, settle

LETTERS = ascii_lowercase + ascii_uppercase + "".join(map(chr, range(0xC0, 0x100)))
LEAST_CHARS, LEAST_TIMES, FACTOR = 7, 2, 10
PARTS, SPOILT = 5, 2
DELETE_ONE_IN = 31


def runs(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """The maximal runs of letters with ``least_chars`` or more, A-Z in lower case."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, ascii_uppercase, ascii_lowercase))


def thinned(doc_id: Column, word: Column, one_in: int = DELETE_ONE_IN) -> Column:
    """``word``, without one of its letters where ``one_in`` divides the crc32 of the id and the word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` (occurrences in all documents)."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs(F.col(text_col), least_chars)).alias("run"))
    words = words.select(thinned(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def signed(words: DataFrame, parts: int = PARTS, spoilt: int = SPOILT, ends: int = LEAST_CHARS // 2) -> DataFrame:
    """``key``, ``word``, ``n``: all keys (bigint) under which the words one edit away from ``word`` are met.

    The steps are columns of their own, so that none is computed once per key.
    """
    rows = words.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), ""))
    others = ["".join(c for i, c in enumerate(LETTERS) if i % parts != p) for p in range(parts)]
    rows = rows.withColumns({f"p{p}": F.translate("letters", o, "") for p, o in enumerate(others)})  # each part's letters, sorted
    chosen = list(combinations(range(parts), parts - spoilt))
    rows = rows.withColumns({f"s{i}": F.xxhash64(F.lit(i), *[F.col(f"p{p}") for p in c]) for i, c in enumerate(chosen)})
    rows = rows.withColumns({"head": F.xxhash64(F.substring("word", 1, ends)), "tail": F.xxhash64(F.lit(0), F.substring("word", -ends, ends))})
    keys = [F.xxhash64(f"s{i}", side) for i in range(len(chosen)) for side in ("head", "tail")]
    return rows.select("word", "n", F.array(*keys).alias("keys")).select(F.explode_outer("keys").alias("key"), "word", "n")  # outer: no filter on the keys is put below


def near_words(words: DataFrame, parts: int = PARTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: all ordered pairs of ``words`` that differ by exactly one edit, each once."""
    n = parts_for(words)
    # both sides of the join are one exchange
    keyed = signed(words.repartition(n), parts, SPOILT, least_chars // 2).repartition(n, "key")
    other = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    lengths = F.abs(F.octet_length("word") - F.octet_length("near")) <= 2
    met = keyed.join(other, "key").filter(lengths & (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return met.select("word", "n", "near", "near_n").distinct()


def with_forms(words: DataFrame, near: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` of every word."""
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(found, "word", "left")
    strong = F.col("best.near_n") >= factor * F.col("n")
    form = [F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("best.near_n")).alias("form_n")]
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *form)


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds ``root``, the last of the forms that follow from a word; each round doubles the distance."""
    steps = settle(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on"))
        moved = settle(moved, "roots")
        steps = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            break
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, parts: int = PARTS, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, factor: int = FACTOR,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of the documents."""
    words = settle(vocabulary(docs, least_chars, least_times, id_col, text_col), "words")
    formed = settle(with_forms(words, near_words(words, parts, least_chars), factor), "forms")
    return with_roots(formed)
