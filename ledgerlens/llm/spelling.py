"""Spelling variants of words: pairs within one edit, by asymmetric chunks.

Of two words the shorter one contributes two disjoint chunks, its halves; the
other contributes its grams of a chunk's length and place. One edit leaves one
chunk as it is: the first where it was, the second shifted by the difference
of the lengths, which is one at most. Of all positional grams within shift one
only those two can belong to a word within one edit, so only they are joined.
A chunk that many words have is split further: the edit lies in the rest of
the word, so one of the rest's two halves is left as it is too, and is added
to the key. What meets is verified by its edit distance inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, measured, table, written
from ledgerlens.llm.decontaminate import lowered

#: Code points and occurrences of a word, and how many times as often its form must occur.
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: Comparisons of one chunk's words beyond which it is split.
CROWDED = 4096
#: Split chunks, of a few bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_CHUNKS = 50_000


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): maximal runs of Latin-1 letters, A-Z in lower case, of every text; a null text has none."""
    found = F.regexp_extract_all(lowered(F.col("text")), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(found).alias("run"))


def slipped(run: Column, doc_id: Column) -> Column:
    """The run, without one letter where 97 divides the crc32 of ``id:run``; a null id is an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of so many code points and occurrences, with slips made as :func:`slipped` says."""
    word = slipped(F.col("run"), F.col("doc_id"))
    return runs(docs).select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _end(word: Column, n: Column) -> Column:
    """The last n code points."""
    return F.substr(word, F.length(word) - n + 1)


def _parts(size: Column) -> tuple[Column, Column, Column]:
    """Code points of the first chunk of a word of ``size``, and of the first half of the rest after it and before the other chunk."""
    half = F.floor(size / 2).cast("int")
    return half, F.floor((size - half) / 2).cast("int"), F.floor(half / 2).cast("int")


def _gram(kind: int, chunk: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), chunk.alias("chunk"))


def _grams(words: DataFrame) -> DataFrame:
    """(word, n, size, own, kind, chunk): the chunks of words of ``size`` that a word may share, 0 the first and 1 the second.

    ``own`` says that size is the word's, so that these are its chunks; else
    size is one less and these are its grams at the places of such chunks.
    """
    w, size = F.col("word"), F.col("size")
    half = _parts(size)[0]
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size"))
    both = F.array(_gram(0, F.left(w, half)), _gram(1, _end(w, size - half)))
    return sized.select("word", "n", "size", (F.length("word") == size).alias("own"), F.inline(both))


def _finer(grams: DataFrame) -> DataFrame:
    """The grams with half of the rest of the word in their chunk; kinds 2 and 3 of 0, 4 and 5 of 1."""
    w, size = F.col("word"), F.col("size")
    half, after, before = _parts(size)
    first = F.array(_gram(2, F.left(w, half + after)), _gram(3, F.concat(F.left(w, half), F.lit(" "), _end(w, size - half - after))))
    second = F.array(_gram(4, F.concat(F.left(w, before), F.lit(" "), _end(w, size - half))), _gram(5, _end(w, size - before)))
    return grams.select("word", "n", "size", "own", F.inline(F.when(F.col("kind") == 0, first).otherwise(second)))


def _met(grams: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): words that share a chunk and are one edit apart; each pair by the first of its chunks alone."""
    on = ["size", "kind", "chunk"]
    left = grams.where("own").select(*on, F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = grams.select(*on, F.col("word").alias("b"), F.col("n").alias("n_b"), "own")
    half, after, before = _parts(F.col("size"))
    apart = lambda n: F.left("a", n) != F.left("b", n)
    # A pair that shares the first chunk, or the first half of the rest, has been met by it.
    new = F.when(F.col("kind").isin(0, 2), True).when(F.col("kind") == 3, apart(half + after)).when(F.col("kind") == 5, apart(half) & apart(before)).otherwise(apart(half))
    keys = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]
    named = left.alias("l").join(right.alias("r").hint("merge"), keys)
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    pairs = named.select("l.size", "l.kind", "a", "b", "n_a", "n_b", "own")
    return pairs.where(once & (F.levenshtein("a", "b", 1) == 1) & new).select("a", "b", "n_a", "n_b")


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of words (word, n), of four code points at least, that one edit turns into each other, each once."""
    grams = _grams(words)
    counts = grams.groupBy("size", "kind", "chunk").agg(F.count_if("own").alias("x"), F.count("*").alias("y"))
    many, seen = measured(counts.where(F.col("x") * F.col("y") > crowded).select("size", "kind", "chunk"), "crowded-chunks", n=F.count(F.lit(1)))
    if not seen["n"]:
        return _met(grams)
    keys = F.broadcast(many) if seen["n"] <= BROADCAST_CHUNKS else many
    on = ["size", "kind", "chunk"]
    return _met(grams.join(keys, on, "left_anti").unionByName(_finer(grams.join(keys, on, "left_semi"))))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead; each round doubles the steps, and counts grow at each, so it ends."""
    now, seen = measured(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots", n=F.count(F.lit(1)))
    while seen["n"]:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further, seen = measured(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots", n=F.count_if("moved"))
        discard(now)
        now = further
    return now.drop("moved")


def variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``letters`` code points and ``least`` occurrences.

    Two words are near if one code point inserted, deleted or replaced turns
    one into the other. A word's form is its near word of largest n, the first
    in code-point order of several, if that occurs ``ratio`` times as often at
    least; else null. The root is where forms lead, the word itself if it has
    none. ``letters`` is five at least and ``ratio`` two.

    Texts are read whole; null, empty and letterless ones have no words.
    Repeated rows count each. A null id is an empty string where slips are
    drawn. Columns but doc_id and text are left out. An empty table, or one
    without frequent words, gives no rows. No group of words is collected:
    a crowded chunk is split, and a pair takes part as soon as it is verified.
    """
    if letters < LEAST_LETTERS or ratio < RATIO:
        raise ValueError(f"words of {LEAST_LETTERS} code points at least, and forms {RATIO} times as often at least")
    words = written(vocabulary(docs, letters, least), "words")
    pair = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"n_{b}").alias("near_n"))
    both = near_words(words, crowded).select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    enough = -F.col("best.order") >= F.col("n") * ratio
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_asymmetric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: DuckDB: crc32 from its polynomial, near words by the variants with one code point less.
OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::varchar, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
per AS (SELECT d, run, count(*) AS n, encode(d || ':' || run) AS b FROM runs GROUP BY ALL),
lut AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t FROM range(256) r(v)),
hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(octet_length(b)), lambda i: ('0x' || hex(b)[2 * i + 1:2 * i + 2])::bigint), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) AS h FROM per, lut),
words AS (
  SELECT w AS word, sum(n)::bigint AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS w FROM hashed)
  WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS v FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, near, near_n FROM (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN words b ON a.v = b.word)
  UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
walk AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near::bigint AS n_near, form_n FROM forms JOIN ends USING (word)
"""
