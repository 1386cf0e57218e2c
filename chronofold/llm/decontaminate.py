"""Benchmark decontamination with DataFrame functions only.

Test items become windows of consecutive words. A bit set over the windows' hashes, whose size is bounded before it goes
into the plan, lets each document name the few places where a window may stand; only these meet the windows
themselves, where equal hashes are verified word by word. Everything else stays in the document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import ascii_lower
from chronofold.session import cut

WINDOW = 10
#: Fixed value: what counts as a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits for each window: about one word position in so many passes the bit set by chance.
BITS_PER_WINDOW = 64
#: The bit set has at most so many 64-bit words (8 MB, for a million windows); more windows share them, so that more positions pass by chance.
SET_WORDS = 1 << 20
#: Windows are broadcast up to this many characters of text, and joined by a shuffle beyond it.
BROADCAST_CHARS = 16_000_000
#: Contaminated documents (an id and a digest each) are broadcast up to this many.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _window_hash(listed: Column, at: Column, n: Column) -> Column:
    """A hash of four words of the window of ``n`` words at place ``at`` (from 1): equal windows have equal hashes, and few others do."""
    return F.xxhash64(*(F.get(listed, at - 1 + k) for k in (F.lit(0), (n / 3).cast("int"), (2 * n / 3).cast("int"), n - 1)))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(n, h, window, item_ids): each distinct window with its number of words, hash, text and the items that have it.

    A null id stands for no item; its windows count for hits all the same.
    """
    listed = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    cut = listed.select("item_id", "w", F.least(F.size("w"), F.lit(size)).alias("n"))
    each = cut.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice(F.col("w"), i, F.col("n")))).alias("v"))
    return each.groupBy("n", _window_hash(F.col("v"), F.lit(1), F.col("n")).alias("h"), F.array_join("v", " ").alias("window")).agg(F.collect_set("item_id").alias("item_ids"))


def _covered(spans: Column) -> Column:
    """Words under the union of spans (start, n)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], span["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step)["n"]


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """One row for each distinct (id, text): id, digest, n_words, copies, spans array<struct<start,n>>, item_ids (sorted as strings).

    ``digest`` is the text's SHA-256, so rows that share an id but not a text stay apart. Documents are scanned once; what
    is shuffled is one small row for each document and each possible hit. Every place goes through the bit set, however
    many windows there are: with w of them a share of about w / 64 SET_WORDS of the places passes by chance.
    """
    tests = windows(items, item_col, "text", size)
    about = tests.groupBy("n").agg(F.count("*").alias("count"), F.sum(F.length("window")).alias("chars")).collect()
    n_windows, chars = sum(r["count"] for r in about), sum(r["chars"] for r in about)
    sizes = sorted(r["n"] for r in about)
    base = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("\0null")), 256).alias("digest"), words(F.col(text_col)).alias("w"))
    n_words_of_set = min(SET_WORDS, 1 << max(4, (n_windows * BITS_PER_WINDOW // 64).bit_length()))
    if n_windows:
        mask = n_words_of_set - 1
        slots = tests.groupBy(F.shiftright("h", 6).bitwiseAND(F.lit(mask)).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect()
        filled = [0] * n_words_of_set
        for r in slots:
            filled[r["slot"]] = r["bits"]
        bits = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")  # folded into one literal

        def may(h: Column) -> Column:
            word = F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(mask)).cast("int"))
            return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    listed = F.col("w")

    def places(n: int) -> Column:
        positions = F.when(F.size(listed) >= n, F.sequence(F.lit(1), F.size(listed) - n + 1)).otherwise(F.array().cast("array<int>"))
        all_places = F.transform(positions, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), _window_hash(listed, i, F.lit(n)).alias("h")))
        return F.filter(all_places, lambda p: may(p["h"]))

    found = F.concat(*map(places, sizes)) if sizes else None
    nothing = F.array().cast("array<struct<start:int,n:int,h:bigint,window:string>>")
    named = nothing if found is None else F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["h"].alias("h"), F.array_join(F.slice(F.col("w"), p["start"], p["n"]), " ").alias("window")))
    scanned = base.select("id", "digest", F.size("w").alias("n_words"), named.alias("places"))
    each = scanned.select("id", "digest", "n_words", F.posexplode_outer("places").alias("k", "p")).select(
        "id", "digest", "n_words", F.coalesce("k", F.lit(0)).alias("k"), F.col("p.start").alias("start"), F.col("p.n").alias("n"), F.coalesce("p.h", F.xxhash64("digest")).alias("h"), F.col("p.window").alias("window")
    )  # a document without places keeps one row, whose hash is its own so that such rows spread
    right = F.broadcast(tests) if chars <= BROADCAST_CHARS else tests
    met = each.join(right, ["n", "h", "window"], "left")
    span = F.when(F.col("item_ids").isNotNull(), F.struct("start", "n"))
    grouped = met.groupBy("id", "digest").agg(F.first("n_words").alias("n_words"), F.count_if(F.col("k") == 0).alias("copies"), F.collect_set(span).alias("spans"), F.collect_set("item_ids").alias("sets"))
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("sets")), lambda x: x.cast("string")))
    return grouped.select("id", "digest", "n_words", "copies", "spans", ids.alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    Null and empty texts have no words and are never hit; an empty table of items hits nothing. Repeated rows give
    repeated rows. Other columns are not carried.
    """
    each = hits(docs, items, id_col, text_col, size, item_col).withColumn("n_hit", F.coalesce(_covered(F.col("spans")), F.lit(0)))
    return each.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, item_col: str = "item_id") -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept. Cases as :func:`report`.

    The contaminated rows' ids are written first and counted: up to BROADCAST_ROWS of them go to all executors, so that
    texts stay where they are; more of them are joined by a shuffle.
    """
    bad = cut(hits(docs, items, id_col, text_col, size, item_col).filter(F.size("spans") > 0).select(F.col("id").alias("_bad_id"), F.col("digest").alias("_bad_digest")))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("\0null")), 256)
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad_id")) & (digest == F.col("_bad_digest")), "left_anti")
