"""Phrase collocations from a weighted de Bruijn graph of each language.

Nodes are two words in a row, edges are three: an edge joins the nodes of its
first and its last two words and weighs as many times as the three occur.
Edges are the only thing that is counted in texts. A piece's end is an edge to
an end mark, so a node's count is what flows out of it: its edges and the
pieces that end with it; a word's count is what flows out of the nodes that
begin with it. Where all that leaves a node arrives at one other node, and all
of that comes from it, the two are links of a unary path; paths are compacted,
their inner nodes have the path's weight and are no phrases of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, discard, looked_up, measured, table, written

#: Least count of a phrase, phrases of a language, and the share in percent of a phrase's places from which a longer one replaces it.
LEAST_COUNT, TOP, SHARE = 10, 2000, 50
#: Bytes of text whose edges are added up before they are dealt out, and bytes of text for each partition they are dealt to.
BLOCK, DEALT = 1 << 23, 1 << 24

_byte = np.arange(256)
#: 0 for a byte of a word, 1 for a blank, 2 for the end of a piece.
_KIND = np.where(np.isin(_byte, [0x20, 0x09]), 1, np.where(np.isin(_byte, [ord(c) for c in ".,;:!?\n\x0b\x0c\r"]), 2, 0)).astype(np.uint8)


def _counted(raw: np.ndarray, at: np.ndarray, lang: np.ndarray, langs: pa.Array) -> Iterator[pa.RecordBatch]:
    """Edges (lang, node, next, n) of consecutive texts; at a piece's end next is null, and for its last word the node is that word."""
    low, rel = kernels.LOWER[raw[at[0] : at[-1]]], at - at[0]
    kind = _KIND[low]
    is_word, edge = kind == 0, rel[(rel > 0) & (rel < len(low))]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    first[edge] = is_word[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    cut = (kind == 2).astype(np.int32)
    np.add.at(cut, edge, 1)
    piece = np.cumsum(cut, dtype=np.int32)[starts]
    places = np.append(np.cumsum(is_word, dtype=np.int32)[starts] - 1, is_word.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(low[is_word])).dictionary_encode()
    size = len(words.dictionary)
    named, own = np.unique(lang[np.searchsorted(rel, starts, "right") - 1].astype(np.int64) * size + words.indices.to_numpy(), return_inverse=True)
    end, base = len(named), len(named) + 1

    def following(k: int) -> np.ndarray:
        out = np.full(len(own), end, np.int64)
        if len(own) > k:
            out[:-k] = np.where(piece[k:] == piece[:-k], own[k:], end)
        return out

    pair = own * base + following(1)
    if base**3 < 1 << 63:
        pairs, rank = None, pair
    else:
        pairs, rank = np.unique(pair, return_inverse=True)
    found, n = np.unique(rank * base + following(2), return_counts=True)
    pair = found // base if pairs is None else pairs[found // base]
    a, b, c = pair // base, pair % base, found % base
    spelled = lambda ids: words.dictionary.take(pa.array(named[np.minimum(ids, end - 1)] % size, mask=ids == end))
    node = pc.binary_join_element_wise(spelled(a), spelled(b), " ", null_handling="skip")
    whole = pa.RecordBatch.from_arrays([langs.take(pa.array(named[a] // size)), node, spelled(c), pa.array(n, pa.int64())], ["lang", "node", "next", "n"])
    for lo in range(0, len(n), 1 << 16):
        yield whole.slice(lo, 1 << 16)


def _edges(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].fill_null("und").dictionary_encode()
        raw, at = kernels.utf8(batch["text"])
        lang = langs.indices.to_numpy()
        for lo, hi in kernels.chunks(at, block):
            yield from _counted(raw, at[lo : hi + 1], lang[lo:hi], langs.dictionary)


def _word(node: Column) -> Column:
    return F.substring_index(node, " ", 1)


def graph(docs: DataFrame, least: int = LEAST_COUNT, block: int = BLOCK) -> DataFrame:
    """(edge, lang, word, node, next, n), written once: edges of ``least`` weight, those to an end among them, and what flows out of nodes.

    Rows that are no edges are nodes of ``least`` flow, and with a null node
    the flow of all others that begin with ``word``. Edges are dealt by their
    node, so both are added up from one shuffle.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // DEALT))
    counted = arrow_job(rows, partial(_edges, block=block), "lang string, node string, next string, n long").repartition(parts, "lang", "node")
    edges = counted.groupBy("lang", "node", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # The ends are summed up apart so that both branches read the same columns, and so the same shuffle; a filter by them here would go below it.
    going, ending = F.sum(F.when(F.col("next").isNotNull(), F.col("n"))), F.sum(F.when(F.col("next").isNull(), F.col("n")))
    flow = counted.groupBy("lang", "node").agg((F.coalesce(going, F.lit(0)) + F.coalesce(ending, F.lit(0))).alias("n"))
    kept = F.when((F.col("n") >= least) & F.col("node").contains(" "), F.col("node"))
    nodes = flow.groupBy("lang", _word(F.col("node")).alias("word"), kept.alias("node")).agg(F.sum("n").alias("n"))
    both = edges.select(F.lit(True).alias("edge"), "lang", _word(F.col("node")).alias("word"), "node", "next", "n").unionByName(nodes.withColumns({"next": F.lit(None).cast("string"), "edge": F.lit(False)}))
    return written(both, "phrase-graph")


def unary_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, node, tail, steps): nodes whose whole flow goes to one other node and is all that arrives there, the last node of their path and the links up to it.

    Steps double each round. Nodes of a cycle of such links have no last node and are left out.
    """
    flow = lambda name: nodes.select("lang", F.col("node").alias(name), F.col("n").alias("flow"))
    linked = edges.withColumn("to", F.concat(F.substring_index("node", " ", -1), F.lit(" "), F.col("next")))
    linked = linked.join(flow("node"), ["lang", "node"]).where("n = flow").drop("flow").join(flow("to"), ["lang", "to"]).where("n = flow")
    now, seen = measured(linked.select("lang", "node", F.col("to").alias("tail"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("going")), "paths", n=F.count(F.lit(1)))
    before = None
    while seen["n"] and seen["n"] != before:
        before = seen["n"]
        hop = now.select("lang", F.col("node").alias("tail"), F.col("tail").alias("far"), F.col("steps").alias("more"))
        doubled = now.join(hop, ["lang", "tail"], "left").select("lang", "node", F.coalesce("far", "tail").alias("tail"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("going"))
        further, seen = measured(doubled, "paths", n=F.count_if("going"))
        discard(now)
        now = further
    return now.where("not going").drop("going")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words): the first ``top`` phrases of two and three words of each lang.

    Words and pieces are those of whole texts, A-Z in lower case; a null lang
    is ``und``; null, empty and wordless texts have none; repeated rows count
    each; other columns are left out. n counts the language's words, a the
    phrase. Of the cuts in two the one of the lowest score
    floor(1000000 a a / (l r)) counts, the first of several. A phrase inside a
    longer one with ``share`` percent of its places is left out. Phrases of
    less than ``least`` places are none; an empty table gives no rows. Ties
    in score and a go by the bytes of the phrase. ``path_words`` is the number
    of words of the compacted path through the phrase. All arithmetic is exact
    for counts below 10**15. One text is handled at once, whatever its length.
    """
    found = graph(docs, least, block)
    edges, nodes = found.where("edge and next is not null").select("lang", "node", "next", "n"), found.where("not edge and node is not null").select("lang", "node", "n")
    words = written(found.where("not edge").groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    paths = unary_paths(edges, nodes)

    to = F.concat(F.substring_index("node", " ", -1), F.lit(" "), F.col("next"))
    # Nodes on a path have the count of the longer phrase; of the others, those that a heavy edge holds go.
    longer = edges.select("lang", F.explode(F.array(F.col("node"), to)).alias("node"), "n").groupBy("lang", "node").agg(F.max("n").alias("most"))
    apart = nodes.join(paths.select("lang", "node"), ["lang", "node"], "left_anti") if share <= 100 else nodes
    alone = apart.join(longer, ["lang", "node"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * share))
    part = lambda cut, right, text: F.struct(F.lit(cut).alias("cut"), F.lit(right).alias("right"), text.alias("part"))
    head, last = _word(F.col("node")), F.substring_index("node", " ", -1)
    two = alone.select("lang", F.col("node").alias("phrase"), F.col("n").alias("a"), F.lit(None).cast("string").alias("node"), F.array(part(1, False, head), part(1, True, last)).alias("parts"))
    three = edges.select("lang", F.concat("node", F.lit(" "), "next").alias("phrase"), F.col("n").alias("a"), "node", F.array(part(1, False, head), part(1, True, to), part(2, False, F.col("node")), part(2, True, F.col("next"))).alias("parts"))
    parts = written(two.unionByName(three).select("lang", "phrase", "a", "node", F.inline("parts")), "phrase-parts")
    counts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n").unionByName(nodes.withColumnRenamed("node", "part"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    side = lambda right: F.max(F.when(F.col("right") == right, F.col("n")))
    cuts = looked_up(parts, counts, ["lang", "part"], "n", total).groupBy("lang", "phrase", "a", "node", "cut").agg(side(False).alias("l"), side(True).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("up", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase", "a", "node").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.select("lang", "phrase", "a", "node", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    # Few rows of each language are left: the totals and the paths are joined to them as Spark sees fit.
    ends = paths.groupBy("lang", "tail").agg(F.max("steps").alias("links"))
    through = paths.select("lang", "node", "tail").join(ends, ["lang", "tail"]).select("lang", "node", (F.col("links") + 2).alias("path_words"))
    out = first.join(totals, "lang").join(through, ["lang", "node"], "left")
    own = F.size(F.split("phrase", " ")).cast("long")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", F.coalesce("path_words", own).alias("path_words"))


def op12_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("path_words")


#: DuckDB: all runs of one, two and three words counted as they are.
OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM w, range(1, 4) t(k) WHERE len(ws) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, u.i, array_to_string(ws[:u.i], ' ') AS lw, array_to_string(ws[u.i + 1:], ' ') AS rw FROM c, (SELECT unnest([1, 2]) AS i) u WHERE u.i < c.k),
s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, i, gl.f AS l, gr.f AS r, (1000000::hugeint * a * a) // (gl.f::hugeint * gr.f) AS score
  FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = lw JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = rw),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM s) WHERE o = 1),
held AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(ws[:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::bigint AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
