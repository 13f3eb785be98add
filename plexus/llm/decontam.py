"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings (term, document, position) of the training
tokens whose terms occur in the test items (no other posting can ever be read)
as a table in the shared folder, and a posting for the end of each text, which
tells its length. ``phrase_matches`` goes from the postings of each window's
rarest term to those of the next, shifted by their offsets, and keeps the
places where the lists of all its terms meet. ``proximity_matches`` returns the
places where all terms of a query stand close together. Both read the index
alone, never a text.

Documents are known by two 64-bit hashes of id and text. Terms are known by one
hash: a word of the corpus that shares a test term's hash would count as that
term; with 10^9 words and 10^5 terms the odds are 1 in 100,000.

DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexus.llm.rows import identity, numbered, pick, place
from plexus.plans.scratch import bounded, materialise, settled

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of a text's end; no word, as words have no such symbol.
END = "\n"


def lower_ascii(word: Column) -> Column:
    """Only A-Z are lower-cased; a word of one byte per symbol takes the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text as they stand; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), lambda w: w != "")


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, words) of the distinct windows, and (window_id, item_id) of the items that hold them."""
    items = pick(items, item_id=item_id, text=text)
    w = F.transform(words_of(F.col("text")), lower_ascii)
    cut = (
        items.select(F.col("item_id").cast("string").alias("item_id"), w.alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), F.least(F.lit(window), F.size("w"))).alias("words"))
        .distinct()
    )
    cut = settled(cut.select(F.xxhash64("words").alias("window_id"), "words", "item_id"), "windows")
    return cut.select("window_id", "words").distinct(), cut.select("window_id", "item_id")


@dataclass
class Index:
    """postings: (term, ka, kb, pos); frequencies: (term, n); lengths: (doc_id, ka, kb, n_words), one per row of the table.

    ka and kb are a document's two hashes; rows that repeat an id with the same
    text are one document, whose postings repeat.
    """

    postings: DataFrame
    frequencies: DataFrame
    lengths: DataFrame


def doc_key(doc_id: Column, text: Column) -> Column:
    """Rows that repeat a doc_id with the same text share a key: they have the same matches."""
    a, b = identity(doc_id, text)
    return F.struct(a.alias("ka"), b.alias("kb"))


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Postings of the tokens of ``docs`` that are among ``terms`` (a column word). Null texts have none but their end."""
    end = F.xxhash64(F.lit(END))
    terms = terms.select("word").unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word")))
    terms = settled(terms.select(F.xxhash64("word").alias("term")).distinct(), "terms")
    # Cut first, explode the parts alone: a text beside its parts would be copied for each of them. The parts are not
    # filtered as in words_of: only the first and last can be empty, and the join drops those.
    rows = pick(docs, doc_id=doc_id, text=text)
    cut = rows.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("k"), F.split(F.coalesce(F.col("text"), F.lit("")), BETWEEN_WORDS).alias("parts"))
    lead = (F.element_at("parts", 1) == "").cast("int")
    tail = ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    cut = cut.select("doc_id", "k.ka", "k.kb", lead.alias("lead"), tail.alias("tail"), F.concat("parts", F.array(F.lit(END))).alias("parts"))
    tokens = cut.select("doc_id", "ka", "kb", "lead", "tail", F.posexplode("parts").alias("at", "raw"))
    tokens = tokens.select("doc_id", "ka", "kb", F.xxhash64(lower_ascii(F.col("raw"))).alias("term"), (F.col("at") - F.col("lead") - F.when(F.col("raw") == END, F.col("tail")).otherwise(0)).alias("pos"))
    stored = tokens.join(bounded(terms), "term").select("term", "ka", "kb", "pos", F.when(F.col("term") == end, F.col("doc_id")).alias("doc_id"))
    stored = materialise(stored, "index")
    lengths = stored.where(F.col("term") == end).select("doc_id", "ka", "kb", F.col("pos").cast("long").alias("n_words"))
    postings = stored.where(F.col("term") != end).select("term", "ka", "kb", "pos")
    return Index(postings, settled(postings.groupBy("term").agg(F.count("*").alias("n")), "frequencies"), lengths)


def phrase_matches(index: Index, windows: DataFrame) -> DataFrame:
    """Rows (doc_key, window_id, start, len) of every exact occurrence of a window.

    windows: rows (window_id, words). A window with a term that the corpus
    lacks has no occurrence. The places of the rarest term are kept where the
    next rarest stands at its offset, and what is left where all others do.
    """
    places = windows.select("window_id", F.size("words").alias("len"), F.posexplode("words").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    by_window = Window.partitionBy("window_id")
    ranked = (
        places.join(bounded(index.frequencies), "term", "left")
        .withColumn("found", F.min(F.coalesce("n", F.lit(0))).over(by_window))
        .where("found > 0")
        .withColumn("rank", F.row_number().over(by_window.orderBy("n", "off")))
    )
    ranked = settled(ranked.select("window_id", "len", "off", "term", "rank"), "ranked")
    place_of = ["window_id", "len", "ka", "kb", "start"]
    rarest, second, rest = ranked.where("rank = 1"), ranked.where("rank = 2"), ranked.where("rank > 2")
    found = index.postings.join(bounded(rarest.select("window_id", "len", "off", "term")), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0").select(place_of)
    # Windows of one term are settled by now, those of two after the next list.
    want = found.where("len > 1").join(bounded(second.select("window_id", "off", "term")), "window_id").withColumn("pos", F.col("start") + F.col("off"))
    have = index.postings.join(bounded(second.select("term").distinct()), "term", "left_semi")
    met = want.join(have, ["ka", "kb", "pos", "term"], "left_semi").select(place_of).unionByName(found.where("len = 1"))
    met = settled(met.distinct(), "met")
    want = met.where("len > 2").join(bounded(rest.select("window_id", "off", "term")), "window_id").withColumn("pos", F.col("start") + F.col("off"))
    near = met.where("len > 2").select("ka", "kb").distinct()
    have = index.postings.join(bounded(near), ["ka", "kb"], "left_semi")
    whole = want.join(have, ["ka", "kb", "pos", "term"], "left_semi").groupBy(place_of).agg(F.count("*").alias("terms")).where("terms = len - 2").select(place_of)
    return whole.unionByName(met.where("len <= 2")).select(F.struct("ka", "kb").alias("doc_key"), "window_id", "start", "len")


def proximity_matches(index: Index, queries: DataFrame, within: int) -> DataFrame:
    """Rows (query_id, doc_key, pos): the query's rarest term stands at pos and all its others at most ``within`` words away.

    queries: rows (query_id, words). Terms that the corpus lacks give a query no match.
    """
    places = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word")).withColumn("term", F.xxhash64("word")).join(index.frequencies, "term", "left")
    w = Window.partitionBy("query_id")
    places = places.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(w)).where("least > 0").withColumn("rank", F.row_number().over(w.orderBy("n", "term"))).withColumn("terms", F.count("*").over(w))
    places = settled(places.select("query_id", "term", "rank", "terms"), "places")
    first, rest = places.where("rank = 1"), places.where("rank > 1")
    block = F.floor(F.col("pos") / (within + 1)).cast("long")
    start = index.postings.join(bounded(first), "term").select("query_id", "terms", "ka", "kb", "pos")
    alone = start.where("terms = 1").select("query_id", "ka", "kb", "pos")
    probes = start.where("terms > 1").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    other = index.postings.join(bounded(rest.select("query_id", "term")), "term").select("query_id", "term", "ka", "kb", F.col("pos").alias("at"), F.floor(F.col("pos") / (within + 1)).cast("long").alias("block"))
    near = probes.join(other, ["query_id", "ka", "kb", "block"]).where(F.abs(F.col("at") - F.col("pos")) <= within)
    near = near.groupBy("query_id", "ka", "kb", "pos", "terms").agg(F.count_distinct("term").alias("k")).where("k = terms - 1").select("query_id", "ka", "kb", "pos")
    return near.unionByName(alone).distinct().select("query_id", F.struct("ka", "kb").alias("doc_key"), "pos")


def verdicts(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """What ``contamination`` returns, and the document's key (ka, kb)."""
    windows, holders = windows_of(items, item_id, item_text, window)
    index = build_index(docs, windows.select(F.explode("words").alias("word")), doc_id, text)
    found = settled(phrase_matches(index, windows).select("doc_key.ka", "doc_key.kb", "window_id", "start", "len"), "matches")
    hits = found.select("ka", "kb", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("ka", "kb").agg(F.count("*").alias("n_hit"))
    listed = (
        found.select("ka", "kb", "window_id").distinct().join(bounded(holders.where("item_id is not null")), "window_id").select("ka", "kb", "item_id").distinct()
        .groupBy("ka", "kb").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    )
    per_doc = hits.join(listed, ["ka", "kb"], "left")
    return (
        index.lengths.join(per_doc, ["ka", "kb"], "left")
        .select(
            "ka",
            "kb",
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    how: doc_id, text, item_id and item_text name the columns (found by their
    exact names; others may have any names), window and share the rule. Words
    are runs of a-z (A-Z lower-cased), digits and non-ASCII symbols. A window
    is ``window`` (13) consecutive words of an item; a shorter item, unless it
    has no words, is one window. Words inside any occurrence are hit; a row is
    contaminated if some are, and ``share`` (20) times them are n_words or
    more. Null texts have no words. Items with a null id have their words hit,
    but have no id to list. Items and rows may repeat, ids may be null or of
    any type; empty tables give empty or clean results.
    """
    return verdicts(docs, items, **how).drop("ka", "kb")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, by id and text: another text of the same id has a verdict of its own, as have null ids."""
    away = settled(verdicts(docs, items).where("contaminated").select("ka", "kb").distinct(), "contaminated")
    rows = numbered(docs)
    ka, kb = identity(F.col(f"c{place(docs, 'doc_id')}"), F.col(f"c{place(docs, 'text')}"))
    kept = rows.select("*", ka.alias("ka"), kb.alias("kb")).join(bounded(away), ["ka", "kb"], "left_anti")
    return kept.select(rows.columns).toDF(*docs.columns)
