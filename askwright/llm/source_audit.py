"""Audit of how far the sources of a language lie from each other: distances between all pairs, and the terms that tell a source.

Terms are runs of letters (A-Z lower-cased) and of signs beyond ASCII.  A language keeps the V terms that at least LEAST_DOCS
of its documents hold.  A group, a source of a language, gives a kept term of count c the share 1 + floor(10^9 (c + 5) /
(N + 5 V)), where N is the group's number of kept terms; a language gives its own shares likewise.  All of it is integers.

How it runs:

1. counts: tasks count terms by group in Python dictionaries, flushed at a bound, so a source of a third of all rows sends
   each term once a flush; they are summed by (language, source, term), and each term's documents by (language, term);
2. vectors: a chunk is some CHUNK terms of a language, chosen by hash; a group's counts in a chunk are one packed row of
   term numbers and counts;
3. tiles: the groups of a language are cut into blocks of BLOCK.  A task gets the pair (block, block) and a segment of the
   chunks; a group's vectors are replicated to the tiles of its block, which are as many as there are blocks.  The task reads
   its vectors chunk by chunk, as they come from the sort, adds up its submatrix of distances and holds nothing else:
   2 x BLOCK vectors of one chunk at a time.  Terms that no group of the tile holds all differ by the same amount: they are
   counted, not looked at;
4. submatrices of the segments are summed, pairs are ranked for each group.

The result has a row for every ordered pair of sources of a language: it grows with the square of the number of sources, which
is the report itself, not with the square of any group's rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.llm.common import materialize, slices

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
CHUNK = 512  # terms a chunk, about: a batch of 10,000 vectors stays below 60 MB
SEGMENT = 2048  # chunks a task reads: a million terms
BLOCK = 16  # groups a block
MOST_ENTRIES = 400_000  # distinct (group, term) that a task holds before it sends them on
PIECE = 4 << 20  # bytes of one text that are split at once
#: ASCII other than letters becomes a space, A-Z become a-z; bytes of signs beyond ASCII stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _words(text: bytes):
    """The terms of a text, some megabytes at a time."""
    clean = text.translate(LETTERS)
    begin = 0
    while begin < len(clean):
        end = clean.find(b" ", begin + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[begin:end].split()
        begin = end


class _Tally:
    """Occurrences and documents of each term, by group."""

    def __init__(self):
        self.times, self.docs = defaultdict(Counter), defaultdict(Counter)

    def add(self, group: tuple, text: bytes) -> None:
        seen: set = set()
        for words in _words(text):
            self.times[group].update(words)
            seen.update(words)
        self.docs[group].update(seen)

    def size(self) -> int:
        return sum(map(len, self.times.values()))

    def batches(self):
        for (lang, source), times in self.times.items():
            terms, docs, n = list(times), self.docs[lang, source], len(times)
            columns = [pa.array([lang] * n, pa.binary()), pa.array([source] * n, pa.binary()), pa.array(terms, pa.binary()), pa.array(times.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _local_counts(batches):
    tally = _Tally()
    for batch in batches:
        for part in slices(batch, 2):
            for lang, source, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                tally.add((lang, source), text)
            if tally.size() > MOST_ENTRIES:
                yield from tally.batches()
                tally = _Tally()
    yield from tally.batches()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    raw = docs.select(*[_text(c).cast("binary").alias(c) for c in ("lang", "source", "text")])
    counted = raw.mapInArrow(_local_counts, "lang binary, source binary, term binary, n bigint, docs bigint")
    named = counted.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")
    return named.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n, head: the kept terms' rows; head marks one row of each term."""
    term = Window.partitionBy("lang", "term")
    told = counts.withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "head": F.row_number().over(term.orderBy("source")) == 1})
    return told.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "head")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, number (from 0 in the language), total (N), lang_total, terms (V) of every group that occurs."""
    groups = docs.select(_text("lang").alias("lang"), _text("source").alias("source")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"))
    joined = groups.join(sums, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    return joined.select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("number"), F.coalesce("total", zero).alias("total"),
        F.coalesce(F.sum("total").over(lang), zero).alias("lang_total"), F.coalesce(F.sum("heads").over(lang), zero).alias("terms"),
    )


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) by decimals of 38 digits."""
    n, total, terms = (f"CAST({x} AS DECIMAL(19, 0))" for x in (n, total, terms))
    return F.expr(f"1L + ({SCALE}BD * ({n} + {PRIOR})) div ({total} + {PRIOR} * {terms})")


def telling_terms(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The first terms of each group by how far their share exceeds the language's; the rest is cut before the shuffle."""
    rows = kept.join(groups, ["lang", "source"])
    value = _share("n", "total", "terms") - _share("lang_n", "lang_total", "terms")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")
    return told.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def vectors(kept: DataFrame, chunks: int) -> DataFrame:
    """lang, source, chunk, at (numbers of the terms in the chunk), n (their counts): one packed row a group and chunk."""
    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"))
    numbered = dealt.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    packed = numbered.groupBy("lang", "chunk", "source").agg(F.collect_list(F.struct("at", "n")).alias("packed"))
    return packed.select("lang", "source", "chunk", F.col("packed")["at"].alias("at"), F.col("packed")["n"].alias("n"))


def _tiles(blocks: Column, block: Column) -> Column:
    """(low, high) of the tiles that a block takes part in: itself with every block."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(other, block).alias("low"), F.greatest(other, block).alias("high")))


def shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 5) / below), three digits at a time: exact in 64 bits while below stays under 9.2e15, far more
    terms than 10 PB of text hold."""
    above = n + PRIOR
    whole, rest = above // below, above % below
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // below, rest % below
    return whole + 1


class _Tile:
    """The submatrix of one tile, added up chunk by chunk."""

    def __init__(self):
        self.sources, self.numbers, self.below = [], [], []
        self.terms, self.place, self.sum = 0, {}, None

    def head(self, source: str, number: int, total: int, terms: int) -> None:
        self.place[number] = len(self.sources)
        self.sources.append(source)
        self.numbers.append(number)
        self.below.append(max(1, total + PRIOR * terms))
        self.terms = terms

    def start(self) -> None:
        self.below = np.array(self.below, np.int64)
        self.unseen = shares(np.zeros(len(self.below), np.int64), self.below)
        self.same = np.abs(self.unseen[:, None] - self.unseen[None, :])
        self.sum = np.zeros_like(self.same)

    def chunk(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Add the distances over a chunk's terms, beyond what terms that no group holds would give."""
        seen = np.unique(np.concatenate([at for _, at, _ in rows]))
        counts = np.zeros((len(self.below), len(seen)), np.int64)
        for number, at, n in rows:
            counts[self.place[number], np.searchsorted(seen, at)] = n
        share = shares(counts, self.below[:, None])
        for i in range(len(share)):
            self.sum[i] += np.abs(share - share[i]).sum(axis=1)
        self.sum -= len(seen) * self.same

    def rows(self, low: int, high: int, segment: int, block: int):
        """Ordered pairs between the two blocks: names of both sides and their distance."""
        if self.sum is None:
            self.start()
        total = self.sum + (self.terms * self.same if segment == 0 else 0)
        side = np.array([x // block for x in self.numbers])
        i, j = np.nonzero((side[:, None] == low) & (side[None, :] == high) | (side[:, None] == high) & (side[None, :] == low))
        keep = i != j
        names = np.array(self.sources, object)
        return names[i[keep]], names[j[keep]], total[i[keep], j[keep]]


def _submatrices(block: int):
    """Rows sorted by tile and chunk to the pairs of each tile."""

    def run(batches):
        key = tile = chunk = None
        held: list = []

        def settle():
            if held:
                tile.chunk(held)
                held.clear()

        def done():
            settle()
            lang, low, high, segment = key
            source, item, value = tile.rows(low, high, segment, block)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

        for batch in batches:
            at, n = batch.column("at"), batch.column("n")
            begins, ats, ns = at.offsets.to_numpy(), at.values.to_numpy(), n.values.to_numpy()
            names = ("lang", "low", "high", "segment", "chunk", "source", "number", "total", "terms")
            for k, (lang, low, high, segment, c, source, number, total, terms) in enumerate(zip(*(batch.column(x).to_pylist() for x in names))):
                if key != (lang, low, high, segment):
                    if key is not None:
                        yield done()
                    key, tile, chunk = (lang, low, high, segment), _Tile(), -1
                if c < 0:  # the groups of a tile come before its chunks
                    tile.head(source, number, total, terms)
                    continue
                if c != chunk:
                    settle()
                    chunk = c
                if tile.sum is None:
                    tile.start()
                held.append((number, ats[begins[k] : begins[k + 1]].copy(), ns[begins[k] : begins[k + 1]].copy()))
        if key is not None:
            yield done()

    return run


def pair_distances(kept: DataFrame, groups: DataFrame, chunk: int = CHUNK, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item (another source of the language), value (distance), rank: every ordered pair."""
    most = groups.agg(F.max("terms")).first()[0] or 0
    chunks = max(1, -(-most // chunk))
    lang = Window.partitionBy("lang")
    blocks = groups.select("lang", "source", "number", "total", "terms", F.floor(F.col("number") / block).cast("int").alias("block"), (F.floor(F.max("number").over(lang) / block) + 1).cast("int").alias("blocks"))
    tiles = F.explode(_tiles(F.col("blocks"), F.col("block"))).alias("tile")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    heads = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // segment))).alias("segment")).select(
        "lang", "source", "number", "total", "terms", "segment", F.lit(-1).alias("chunk"), none("int").alias("at"), none("bigint").alias("n"), tiles
    )
    body = vectors(kept, chunks).join(blocks, ["lang", "source"]).select(
        "lang", F.lit("").alias("source"), "number", "total", "terms", F.floor(F.col("chunk") / segment).cast("int").alias("segment"), "chunk", "at", "n", tiles
    )
    key = ["lang", "low", "high", "segment"]
    flat = heads.unionByName(body).select("lang", F.col("tile.low").alias("low"), F.col("tile.high").alias("high"), "segment", "chunk", "source", "number", "total", "terms", "at", "n")
    sorted_ = flat.repartition(*key).sortWithinPartitions(*key, "chunk", "number")
    parts = sorted_.mapInArrow(_submatrices(block), "lang string, source string, item string, value bigint")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, chunk: int = CHUNK, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language, part `term` the first terms.

    Null text, lang and source count as empty.  Repeated rows are documents of their own.  Every group that occurs has its
    pairs, also without terms; where a language keeps no term, distances are 0.  A language of one source has no pairs.  Ties
    rank by the item's bytes.  Long texts are read whole, in pieces.  An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    kept = materialize(kept_terms(term_counts(docs), least_docs), "kept-terms")
    groups = materialize(group_table(docs, kept), "groups")
    return pair_distances(kept, groups, chunk, segment, block).unionByName(telling_terms(kept, groups, top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM vocabulary GROUP BY lang),
pairs AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
       1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v)::HUGEINT AS p,
       1 + (1000000000::HUGEINT * (w.lang_n + 5)) // (s.lang_total + 5 * s.v)::HUGEINT AS q
     FROM pairs g JOIN vocabulary w USING (lang) JOIN sizes s USING (lang)
     LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term
     LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
              FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
told AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
         FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN distances x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM told)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
