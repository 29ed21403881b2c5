"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become words (runs of letters and digits, lower case) and words become
64-bit hashes.  A fixed mask picks some positions of a window and ignores the
others, so a window keeps its hash when words at ignored positions are
substituted.  Hashes of all windows of all documents meet those of the
benchmark; each meeting names a document, an item and the diagonal on which
they align.  Along that diagonal the words are compared one by one, and a pair
is contaminated when some window of ``window`` words (the whole item, if
shorter) agrees in ``least_percent`` of its places.

The masks are chosen so that whichever places of a window are substituted, as
many as the percentage allows, one mask still hits: nothing that the comparison
would accept is missed.  Items shorter than the window are cut into one block
more than words may be substituted, so that one block is whole; the documents'
windows of such a block's length meet it.

Defined results: null and empty texts never match; an empty benchmark matches
nothing; an item of few words is found wherever they stand in a row; repeated
rows with one id are one document, contaminated if any of its rows is; of equal
windows the best counts; all windows of a text of any length are looked up, as
one list in a row; an empty table gives no rows; rows without an id are reported under a null id, and
``drop_contaminated`` drops them together; columns of any other name may stand
beside id and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import Scratch


@dataclass(frozen=True)
class SpacedSeeds:
    #: 1: the position counts; 0: any word may stand there.  Of 13 places any two may differ and one mask still hits.
    masks: tuple[str, ...] = ("1101101011", "111010011", "11001111")
    window: int = 13
    least_percent: int = 80
    #: Benchmark windows are sent to all executors up to so many; beyond, they meet the documents in a shuffle.
    broadcast_windows: int = 2_000_000
    #: The same for hits, whose documents and items are read again to be verified.
    broadcast_hits: int = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashed(rows: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    """(id as ``name``, h, pairs): hashes of words and of adjacent words."""
    words = rows.select(F.col(id_column).alias(name), word_hashes(F.col(text_column)).alias("h"))
    following = F.slice("h", F.lit(2), F.greatest(F.size("h"), F.lit(1)))
    return words.select(name, "h", F.zip_with("h", following, lambda a, b: F.xxhash64(a, b)).alias("pairs"))


def _masked(number: int, mask: str):
    """The hash of the window at a place, by the words where the mask has a 1; adjacent ones are taken as a pair."""
    picks, k = [], 0
    while k < len(mask):
        two = mask[k : k + 2] == "11"
        if mask[k] == "1":
            picks.append(("pairs" if two else "h", k))
        k += 1 + two
    return lambda i: F.xxhash64(F.lit(number), *(F.get(F.col(column), i + F.lit(k)) for column, k in picks))


def _windows(hashed: DataFrame, masks: list[tuple[int, str]], name: str) -> DataFrame:
    """(id as ``name``, seed, at_<name>): every masked window and where it begins."""
    parts, at, before = [], F.col("p"), F.lit(0)
    for number, mask in masks:
        places = F.sequence(F.lit(0), F.size("h") - F.lit(len(mask)))
        parts.append(F.when(F.size("h") >= len(mask), F.transform(places, _masked(number, mask))).otherwise(F.array().cast("array<bigint>")))
    each = hashed.select(name, F.size("h").alias("n"), F.posexplode(F.concat(*parts)).alias("p", "seed"))
    for _, mask in masks[:-1]:
        before = before + F.greatest(F.col("n") - F.lit(len(mask) - 1), F.lit(0))
        at = F.when(F.col("p") >= before, F.col("p") - before).otherwise(at)
    return each.select(name, "seed", at.alias(f"at_{name}"))


def _blocks(items: DataFrame, seeds: SpacedSeeds) -> DataFrame:
    """(item, h, pairs, at_item, length): the blocks of items shorter than the window."""
    n = F.size("h")
    short = items.where((n > 0) & (n < seeds.window)).withColumn("parts", F.floor(n * (100 - seeds.least_percent) / 100).cast("int") + 1)
    each = short.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begin, end = (F.floor((F.col("j") + F.lit(k)) * n / F.col("parts")).cast("int") for k in (0, 1))
    return each.select("item", "h", "pairs", begin.alias("at_item"), (end - begin).alias("length"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, seeds: SpacedSeeds = SpacedSeeds(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row per contaminated (document, item): their ids, the words that agree in the best window, and its length."""
    texts = _hashed(docs, id_column, text_column, "doc")
    items = _hashed(benchmark, item_column, item_text_column, "item")
    masks = list(enumerate(seeds.masks))
    planted = _windows(items.where(F.size("h") >= seeds.window), masks, "item")
    blocks = _blocks(items, seeds)
    # Lengths of blocks: fewer than the window has words.
    for length in sorted(r[0] for r in blocks.select("length").distinct().collect()):
        mask = 1_000 + length, "1" * length
        masks.append(mask)
        planted = planted.unionByName(blocks.where(F.col("length") == length).select("item", _masked(*mask)(F.col("at_item")).alias("seed"), "at_item"))
    planted = planted.distinct()
    few = planted.limit(seeds.broadcast_windows + 1).count() <= seeds.broadcast_windows
    met = _windows(texts, masks, "doc").join(F.broadcast(planted) if few else planted, "seed")
    scratch = Scratch(docs.sparkSession, "seeds")
    hits = scratch.write(met.select("doc", "item", (F.col("at_doc") - F.col("at_item")).alias("shift")).distinct())
    small = hits.limit(seeds.broadcast_hits + 1).count() <= seeds.broadcast_hits
    near = F.broadcast if small else (lambda df: df)

    def read_again(rows: DataFrame, name: str, column: str, own_id: str, own_text: str) -> DataFrame:
        """Words of the documents or items that have a hit."""
        wanted = hits.select(F.col(name).alias("wanted")).distinct()
        rows = rows.select(F.col(own_id).alias(f"own_{name}"), F.col(own_text).alias("own_text"))
        return rows.join(near(wanted), F.col(f"own_{name}").eqNullSafe(F.col("wanted")), "left_semi").select(f"own_{name}", word_hashes(F.col("own_text")).alias(column))

    x, y = read_again(docs, "doc", "x", id_column, text_column), read_again(benchmark, "item", "y", item_column, item_text_column)
    aligned = x.join(near(hits), F.col("own_doc").eqNullSafe(F.col("doc"))).join(near(y), F.col("item").eqNullSafe(F.col("own_item")))
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("y"), F.size("x") - F.col("shift"))
    aligned = aligned.withColumn("low", low).withColumn("len", high - low).where("len > 0")
    same = F.zip_with(F.slice("y", F.col("low") + 1, F.col("len")), F.slice("x", F.col("low") + F.col("shift") + 1, F.col("len")), lambda a, b: (a == b).cast("int"))
    width = F.least(F.lit(seeds.window), F.size("y"))
    aligned = aligned.select("doc", "item", same.alias("same"), width.alias("n_window")).where("size(same) >= n_window")
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("n_window") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("n_window")), F.lit(0), lambda a, b: a + b))
    best = aligned.select("doc", "item", F.array_max(sums).alias("n_agree"), "n_window")
    found = best.where(100 * F.col("n_agree") >= seeds.least_percent * F.col("n_window"))
    out = found.groupBy("doc", "item").agg(F.max("n_agree").alias("n_agree"), F.max("n_window").alias("n_window"))
    return out.select(F.col("doc").alias(id_column), F.col("item").alias(item_column), "n_agree", "n_window")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seeds: SpacedSeeds = SpacedSeeds(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows without any contaminated pair, with the columns they came with."""
    found = contaminated_pairs(docs, benchmark, seeds, id_column, text_column)
    gone = Scratch(docs.sparkSession, "leaks").write(found.select(id_column).distinct())
    few = gone.limit(seeds.broadcast_hits + 1).count() <= seeds.broadcast_hits
    gone = F.broadcast(gone) if few else gone
    left, right = docs.alias("kept"), gone.alias("gone")
    return left.join(right, F.col(f"kept.`{id_column}`").eqNullSafe(F.col(f"gone.`{id_column}`")), "left_anti").select(docs.columns)
