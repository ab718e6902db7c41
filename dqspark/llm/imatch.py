"""I-Match fingerprints: hashes of the sorted terms inside an idf band, for many lexicon subsets.

The lexicon holds the terms whose document frequency, counted over all documents, lies between
two shares of the number of documents. A document's distinct lexicon terms, sorted, are hashed
once for the whole lexicon and once for each of its randomised subsets, which keep a half, a
quarter, ... of the terms. Copies agree in all hashes; documents that share part of their terms
agree in the subsets that none of their differences fell into; likeness is the share of equal
hashes among the coarsest subsets that are not empty.

Everything runs in DataFrame functions. Texts are shuffled once, by doc_id, together with half of
each text for its predecessor; terms are 64-bit hashes, exploded and gathered again inside the
same partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.session import materialize

#: The idf band, as shares of the documents that hold a term.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
#: Broadcast bound: a lexicon has at most (mean distinct terms of a document) / LEAST_SHARE terms.
LEXICON_MOST = 4_000_000
CHAINS, LEVELS = 4, 11
#: Subsets that likeness compares: the coarsest ones that hold a term of either side.
COMPARED = 8
#: Documents of a task gathered by hashing before the aggregation sorts instead.
GATHERED = 200_000


def term_hashes(text: Column) -> Column:
    """Distinct terms of a text (runs of letters and digits, lower-cased) as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``(term)`` of all terms inside the band; ``docs(text)`` are counted whole."""
    total = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"))
    kept = materialize(counts.filter(F.col("n").between(least * total, most * total)).select("term"),
                       "lexicon")
    size = kept.count()
    if size > LEXICON_MOST:
        raise ValueError(f"{size} terms in the band; raise its lower end")
    return kept


def hashes(frame: DataFrame, terms: str, out: str) -> DataFrame:
    """``frame`` with the hashes of the term array ``terms`` as int array ``out``; 0 means that a
    subset holds no term. Subset (chain, level) keeps half of the terms of (chain, level - 1)."""
    keep = [c for c in frame.columns if c != terms]
    now, made = frame.select(*keep, F.sort_array(terms).alias("s0")), ["s0"]
    for level in range(LEVELS):
        step = []
        for chain in range(CHAINS):
            above = f"s{chain}_{level}" if level else "s0"
            step.append(F.filter(above, _clear(chain * LEVELS + level)).alias(f"s{chain}_{level + 1}"))
        now = now.select(*keep, *made, *step)
        made += [f"s{chain}_{level + 1}" for chain in range(CHAINS)]
    each = [F.when(F.size(n) == 0, 0).otherwise(_int(F.xxhash64(n))) for n in made]
    return now.select(*keep, F.array(*each).alias(out))


def _clear(bit: int):
    return lambda term: F.getbit(F.xxhash64(term), F.lit(bit)) == 0


def _int(x: Column) -> Column:
    """32 bits of a hash, never 0."""
    low = F.pmod(x, F.lit((1 << 32) - 1)) - F.lit((1 << 31) - 1)
    return F.when(low == 0, 1).otherwise(low).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the ``COMPARED`` coarsest subsets that are not empty on both
    sides: few terms fall into these, so it follows the share of terms in common at any length."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    seen = F.slice(F.filter(F.reverse(both), lambda v: v > 0), 1, COMPARED)
    return F.size(F.filter(seen, lambda v: v == 2)) / F.size(seen)


def text_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(
        x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


KEY = ["_none", "_id"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").isNull().alias("_none"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def successors(keyed: DataFrame) -> DataFrame:
    """Each document id with the next one (``_next``), the one before (``_prev``) and the longest
    half that the one before needs (``_half``), in descending order, the last before the first."""
    ids = keyed.groupBy(*KEY).agg(F.max(F.char_length("text")).alias("n"))
    order = [F.col("_none"), F.col("_id").desc()]
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(ids.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()),
                        "ids")
    me = F.struct(*KEY, "n")
    inside = Window.partitionBy("part").orderBy(*order)
    linked = parts.withColumn("_next", F.lead(me).over(inside)).withColumn(
        "_prev", F.lag(me).over(inside))
    rank = F.struct(F.col("_none"), (-F.col("_id")).alias("down"))
    ends = parts.groupBy("part").agg(F.min_by(me, rank).alias("first"), F.max_by(me, rank).alias("last"))
    # one row for each part
    row, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(row), F.first("first").over(every)).alias("_after"),
        F.coalesce(F.lag("last").over(row), F.last("last").over(every)).alias("_before"))
    return linked.join(ends, "part").select(
        *KEY, F.coalesce("_next", "_after").alias("_next"),
        F.coalesce("_prev", "_before").alias("_prev")).select(
        *KEY, F.col("_next._none").alias("_next_none"), F.col("_next._id").alias("_next_id"),
        F.col("_prev._none").alias("_prev_none"), F.col("_prev._id").alias("_prev_id"),
        F.expr("_prev.n div 2").cast("int").alias("_half"))


def _terms(rows: DataFrame, words: DataFrame, sets: dict[str, str]) -> DataFrame:
    """``rows`` with the lexicon terms of each text column of ``sets`` as an array, or the hash of
    the whole text where it has none. Gathers inside the partitions of KEY."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GATHERED))
    keep = [c for c in rows.columns if c not in sets and c not in KEY]
    marked = F.lit(0).cast("long")        # a term that every text has, so that no text is lost
    each = [F.struct(F.lit(i).alias("set"), F.concat(F.array(marked), term_hashes(F.col(c))).alias("terms"))
            for i, c in enumerate(sets)]
    whole = [F.xxhash64(F.lit("whole text"), c).alias(f"_whole_{out}") for c, out in sets.items()]
    long = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        *KEY, *keep, *whole, "_row", F.explode(F.array(*each)).alias("s"))
    long = long.select(*[c for c in long.columns if c != "s"], F.col("s.set").alias("_set"),
                       F.explode("s.terms").alias("term"))
    known = words.unionByName(spark.range(1).select(F.col("id").alias("term"))).distinct()
    found = long.join(F.broadcast(known), "term")
    got = found.groupBy(*KEY, "_row").agg(
        *[F.first(c).alias(c) for c in [*keep, *[f"_whole_{out}" for out in sets.values()]]],
        *[F.collect_list(F.when((F.col("_set") == i) & (F.col("term") != 0), F.col("term"))).alias(out)
          for i, out in enumerate(sets.values())])
    return got.select(*KEY, *keep, *[
        F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(f"_whole_{out}")).alias(out)
        for out in sets.values()])


def edited_neighbours(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE,
                      most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last half replaced by the first half, in its own length, of the next
    document by descending doc_id. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. A null text is empty. Rows without doc_id stand
    last and share a place, as do rows that repeat a doc_id: all of them have the same next
    document, and for the one before them the least of their texts' beginnings and the least of
    their fingerprints stand for them. A text without a lexicon term is its own only term, so it
    is like equal texts alone. A single document is its own next. An empty table stays empty.
    """
    keyed = _keyed(docs, text)
    words = lexicon(keyed, least, most)
    placed = keyed.join(successors(keyed), KEY)
    starts = placed.select(F.col("_prev_none").alias("_none"), F.col("_prev_id").alias("_id"),
                           F.substring("text", F.lit(1), F.col("_half")).alias("start"))
    starts = starts.groupBy(*KEY).agg(F.min("start").alias("start"))
    both = placed.join(starts, KEY)
    size = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half),
                      F.substring("start", F.lit(1), half))
    both = both.select(*KEY, "_next_none", "_next_id", size.cast("long").alias("n_chars"), "text",
                       edited.alias("edited"))
    both = both.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    got = _terms(both, words, {"text": "own", "edited": "other"})
    got = hashes(hashes(got, "own", "fp"), "other", "edited_fp")
    done = materialize(got, "prints")
    following = done.groupBy(F.col("_none").alias("_next_none"), F.col("_id").alias("_next_id")).agg(
        F.min("fp").alias("next_fp"))
    return done.join(following, ["_next_none", "_next_id"]).select(
        F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"), text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
