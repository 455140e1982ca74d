"""Benchmark decontamination by a positional inverted index of the training text; DataFrame functions only.

1. One pass over the documents writes the index: a row (document, term, place) for every token whose term some test item has, as no
   other term is ever asked for, and a head of each document. Items of equal words are one test text.
2. A window is ``window`` consecutive words of a text, or all of a shorter one. Its terms are ordered by the number of their postings; a
   window with a term that has none can't occur.
3. The postings of the rarest term, less its place in the text, are the diagonals on which text and document may agree.
   They are met with the postings of the second rarest term, at its offset, which leaves few; those with the lists of all terms
   of the windows. Windows whose terms all lie on the diagonal are phrases; with each at most ``slack`` places off, proximity
   matches.

A frequent term is many rows of the index and never a group: intersections join by document, term and place, which are
one row. What a join broadcasts is counted first, and shuffled where it is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, picked

# Fixed values of the contract: letters that are lowered, and what stands between words.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows, and bytes of terms, up to which a table of the test texts, or ids of documents, are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 18, 16 << 20


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _few(df: DataFrame, size: Column | None = None) -> DataFrame:
    """For a join: broadcast where it has few rows (and, with ``size``, few bytes), else as it is."""
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.lit(0)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def item_texts(benchmark: DataFrame, work: Workspace, item_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written: items (name, text), places of texts (text, j, term, n), terms (term, tid). Null ids are one item without a name."""
    rows = picked(benchmark, id=item_column, body=text_column).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), words_of(F.col("body")).alias("words"))
    rows = work.put(rows.where(F.size("words") > 0).distinct(), "items")
    texts = work.put(rows.select("words").distinct().withColumn("text", F.monotonically_increasing_id()), "texts")
    items = work.put(rows.join(texts, "words").select("name", "text"), "names")
    places = work.put(texts.select("text", F.size("words").alias("n"), F.posexplode("words").alias("j", "term")), "places")
    terms = work.put(places.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    return items, places, terms


def positional_index(docs: DataFrame, terms: DataFrame, work: Workspace, id_column: str, text_column: str) -> DataFrame:
    """Written: ``uid, tid, pos`` of every token that is one of ``terms``, and a head (tid -1, with doc_id and n_words) of every document."""
    whole = picked(docs, id=id_column, body=text_column).select(F.monotonically_increasing_id().alias("uid"), "id", words_of(F.col("body")).alias("words"))
    tokens = whole.select("uid", "id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("at", "term"))
    asked = terms.unionByName(docs.sparkSession.sql("SELECT '' AS term, -1L AS tid"))
    head = F.col("at") == 0
    rows = tokens.join(_few(asked, F.octet_length("term")), "term")
    return work.put(rows.select("uid", "tid", (F.col("at") - 1).alias("pos"), F.when(head, F.col("id")).alias("doc_id"), F.when(head, F.col("n")).alias("n_words")), "index", "zstd")


def plan_windows(places: DataFrame, terms: DataFrame, index: DataFrame, work: Workspace, window: int) -> DataFrame:
    """Written: windows (text, start, size) that may occur, with ``order``: places and terms from the rarest on."""
    counts = index.where("tid >= 0").groupBy("tid").agg(F.count("*").alias("postings"))
    known = places.join(terms.join(counts, "tid"), "term")  # what has no posting goes, and its windows with it
    size = F.least("n", F.lit(window))
    starts = F.sequence(F.greatest(F.col("j") - size + 1, F.lit(0)), F.least(F.col("j"), F.col("n") - size))
    rows = known.select("text", size.alias("size"), F.explode(starts).alias("start"), F.struct("postings", "j", "tid").alias("member"))
    whole = rows.groupBy("text", "start", "size").agg(F.sort_array(F.collect_list("member")).alias("order"))
    return work.put(whole.where(F.size("order") == F.col("size")).withColumn("i", F.col("order")[0]["j"]), "windows")


def find_matches(index: DataFrame, windows: DataFrame, slack: int, work: Workspace) -> DataFrame:
    """Written: ``uid, text, start, size, diagonal, exact`` of every window that occurs; not ``exact``: only in proximity."""
    postings = index.where("tid >= 0").select("uid", "tid", "pos")
    off = F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("off")

    anchors = windows.select("text", "i", F.col("order")[0]["tid"].alias("tid")).distinct()
    lines = postings.join(_few(anchors), "tid").select("text", "i", "uid", (F.col("pos") - F.col("i")).alias("diagonal"))
    seconds = windows.where("size > 1").select("text", "i", F.col("order")[1]["j"].alias("j"), F.col("order")[1]["tid"].alias("tid")).distinct()
    asked = lines.join(_few(seconds), ["text", "i"]).select("text", "i", "uid", "diagonal", "j", "tid", off)
    asked = asked.select("text", "i", "uid", "diagonal", "tid", (F.col("diagonal") + F.col("j") + F.col("off")).alias("pos")).where("pos >= 0")
    second = postings.join(_few(seconds.select("tid").distinct()), "tid", "left_semi")
    left = asked.join(second, ["uid", "tid", "pos"], "left_semi").select("text", "i", "uid", "diagonal")
    single = windows.where("size = 1").select("text", "i").distinct()
    left = work.put(left.unionByName(lines.join(_few(single), ["text", "i"], "left_semi")).distinct(), "lines")

    members = windows.select("text", "i", F.explode("order").alias("m")).select("text", "i", "m.j", "m.tid").distinct()
    asked = left.join(_few(members), ["text", "i"]).select("text", "i", "uid", "diagonal", "j", "tid", off)
    asked = asked.withColumn("pos", F.col("diagonal") + F.col("j") + F.col("off")).where("pos >= 0")
    there = postings.join(_few(left.select("uid").distinct()), "uid", "left_semi")
    met = asked.join(there, ["uid", "tid", "pos"]).groupBy("text", "i", "uid", "diagonal")
    met = met.agg(F.collect_set(F.when(F.col("off") == 0, F.col("j"))).alias("exactly"), F.collect_set("j").alias("nearly"))
    both = met.join(_few(windows.select("text", "i", "start", "size")), ["text", "i"])
    inside = lambda c: F.size(F.filter(c, lambda j: (j >= F.col("start")) & (j < F.col("start") + F.col("size")))) == F.col("size")
    both = both.where(inside("nearly")).withColumn("exact", inside("exactly"))
    return work.put(both.select("uid", "text", "start", "size", "diagonal", "exact"), "matches", "zstd")


def _search(docs: DataFrame, benchmark: DataFrame, window: int, slack: int, work: Workspace, names: tuple[str, str, str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, places, terms = item_texts(benchmark, work, names[2], names[3])
    index = positional_index(docs, terms, work, names[0], names[1])
    windows = plan_windows(places, terms, index, work, window)
    matches = find_matches(index, windows, slack, work)
    return index.where("tid = -1").select("uid", "doc_id", "n_words"), items, matches


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 1, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``doc_id, item, item_start, doc_start, size, exact``: windows of test items that occur in documents, by words.

    ``exact``: the words stand there as in the item, from ``doc_start`` on. Otherwise each stands at most ``slack`` places from where the
    rarest one puts it. Nulls, empty texts, repeats and other columns: as in ``contamination``.
    """
    with Workspace(docs.sparkSession, "decontamination") as work:
        heads, items, matches = _search(docs, benchmark, window, slack, work, (id_column, text_column, item_column, item_text_column))
        rows = matches.join(items, "text").join(heads.select("uid", "doc_id"), "uid")
        out = work.put(rows.select("doc_id", F.col("name").alias("item"), F.col("start").alias("item_start"), (F.col("diagonal") + F.col("start")).alias("doc_start"), "size", "exact"), "spans")
        work.clear("spans")
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 1, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated, n_near`` for every row of ``docs``.

    Words are runs of letters, digits and anything beyond ASCII, A-Z as a-z. ``n_hit`` counts words inside windows of items that occur
    exactly, ``items`` are the ids, as sorted strings, of items that have one; ``n_near`` counts items with a proximity match or an exact
    one. Null and empty texts have no words and no windows; rows of ``docs`` are told apart, also where ids repeat or are null; items
    of one id are one item, null ids the item ''. Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    with Workspace(docs.sparkSession, "decontamination") as work:
        heads, items, matches = _search(docs, benchmark, window, slack, work, (id_column, text_column, item_column, item_text_column))
        exact = matches.where("exact")
        spans = exact.select("uid", (F.col("diagonal") + F.col("start")).alias("first"), "size").distinct()
        spans = spans.withColumn("end", F.col("first") + F.col("size"))
        done = F.expr("coalesce(max(end) over (partition by uid order by first, end rows between unbounded preceding and 1 preceding), 0)")
        hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("first", done))).groupBy("uid").agg(F.sum("new").alias("n_hit"))
        per_item = matches.groupBy("uid", "text").agg(F.max("exact").alias("exact")).join(items, "text")
        named = per_item.groupBy("uid").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("name")))).alias("items"), F.size(F.collect_set("name")).alias("n_near"))
        out = heads.join(hit, "uid", "left").join(named, "uid", "left")
        none = F.array().cast("array<string>")
        out = out.select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
        out = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "n_near")
        out = work.put(out, "documents")
        work.clear("documents")
        return out
