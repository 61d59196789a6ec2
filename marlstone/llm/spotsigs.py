"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is lower-cased and cut into words of letters and digits. Each anchor (a common word) with
two content words among the ``reach`` words after it gives one signature, the hash of anchor and
chain; the text's fingerprint is the set of its signatures. A text with few anchors (tables, code,
other languages; fewer signatures than ``_FEWEST`` and one for each ``_SPARSE`` words) also has the hash of
each run of three words, so that all of it counts; a text of under three words without a
signature has the hash of its whole word sequence. So equal texts agree, and texts that only begin
alike don't.

Near duplicates: distinct sets are partitioned by length so that sets in one partition or in
neighbouring ones alone can reach the threshold; inside, a set is filed under its rarest
signatures only (as many as a partner must share one of), and candidates are compared by Jaccard
after the length bound. Copies collapse into one set first. How often a signature occurs is counted
in ``_CELLS`` cells of its hash, a number of fixed size, and orders signatures from rare to common
for the prefixes; every order finds all pairs, this one finds them with few candidates.

Ids must be numbers where the next document is asked for. Null text: empty. Empty texts have equal fingerprints and likeness 1. Repeated rows are each
returned; an empty table gives an empty table. Columns that aren't named aren't carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import quoted, settle
from marlstone.llm.simhash import components

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or "
    "that the their this to was were which will with you "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "als auch auf aus das dem den der die ein eine für ich im ist mit nicht sich sie sind und von werden zu "
    "al como con del el es esta los las más no para pero por se sin su sus y"
).split()

REACH, CHAIN = 8, 2
_FEWEST, _SPARSE = 4, 40
_CELLS = 1 << 18


def with_signatures(rows: DataFrame, text_col: str, out_col: str, words_col: str = "__words", spots_col: str = "__spots") -> DataFrame:
    """rows with the signature set of a text; two scratch columns come and go."""
    names = ", ".join(f"'{a}'" for a in sorted(ANCHORS))
    words = F.array_remove(F.split(F.lower(F.coalesce(quoted(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    rows = rows.withColumn(words_col, words)
    spots = (
        f"filter(transform({words_col}, (w, i) -> if(w in ({names}), named_struct('a', w, 'c', "
        f"slice(filter(slice({words_col}, i + 2, {REACH}), v -> v not in ({names})), 1, {CHAIN})), null)), x -> size(x.c) = {CHAIN})"
    )
    rows = rows.withColumn(spots_col, F.expr(f"array_distinct(transform({spots}, x -> xxhash64(x.a, x.c)))"))
    n = f"size({words_col})"
    runs = f"transform(slice({words_col}, 1, {n} - 2), (w, i) -> xxhash64('', w, {words_col}[i + 1], {words_col}[i + 2]))"
    whole = f"array(xxhash64(array_join({words_col}, ' ')))"
    few = f"if({n} < 3, if(size({spots_col}) = 0, {whole}, {spots_col}), array_union({spots_col}, {runs}))"
    rows = rows.withColumn(out_col, F.expr(f"sort_array(if(size({spots_col}) >= {_FEWEST} + {n} div {_SPARSE}, {spots_col}, {few}))"))
    return rows.drop(words_col, spots_col)


def fingerprint(signature_set: Column) -> Column:
    """The set as one string: a digest of its sorted members."""
    return F.sha2(F.array_join(signature_set, " "), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _cuts(docs: DataFrame, id_col: str, groups: int) -> list[int]:
    """At most ``groups`` - 1 ids that cut the ids into groups of about one size."""
    at = [i / groups for i in range(1, groups)]
    found = docs.agg(F.percentile_approx(quoted(id_col), at, 100 * groups).alias("cuts")).first()[0]
    return sorted(set(found or []))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None) -> DataFrame:
    """(id, text, sigs, next_text, next_sigs): each document beside the next by ascending id.

    Ids are cut into ranges by quantiles; a window inside each range looks one row ahead, and the
    last row of a range gets the first of the next range with rows, the very last the very first.
    Only the quantiles (``groups`` numbers, four a shuffle partition and at most 16,384) reach the driver. Equal ids are ordered by text; null
    ids come first.
    """
    spark = docs.sparkSession
    docs = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    groups = groups or min(16_384, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(docs, "id", groups)
    root = max(1, math.isqrt(len(cuts)))
    heads = cuts[::root]
    # Two short searches instead of one over all cuts: the block, then the place in the block.
    kind = docs.schema["id"].dataType.simpleString()
    listed = lambda some: f"array({', '.join(map(str, some))})" if some else f"cast(array() as array<{kind}>)"
    blocks = f"array({', '.join(listed(cuts[a : a + root]) for a in range(0, len(cuts), root))})" if cuts else f"cast(array() as array<array<{kind}>>)"
    docs = docs.withColumn("block", F.expr(f"size(filter({listed(heads)}, x -> x <= id))"))
    inside = f"if(block = 0, 0, size(filter(get({blocks}, block - 1), x -> x <= id)))"
    docs = docs.withColumn("range", F.expr(f"coalesce(greatest(block - 1, 0) * {root} + {inside}, 0)"))

    order = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "text")
    rows = docs.select("range", "id", "text", F.lead("text").over(order).alias("ahead"))
    rows = with_signatures(rows, "text", "sigs")
    rows = rows.withColumn("ahead_sigs", F.lead("sigs").over(order))

    key = F.struct(F.col("id").isNotNull().alias("known"), "id", "text")
    firsts = settle(docs.groupBy("range").agg(F.min(key).alias("first")).select("range", F.col("first.text").alias("text")), "spotsigs-firsts")
    around = Window.orderBy("range")
    everyone = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = firsts.select("range", F.coalesce(F.lead("range").over(around), F.min("range").over(everyone)).alias("then"))
    nexts = turns.join(with_signatures(firsts.select(F.col("range").alias("of"), "text"), "text", "sigs"), F.col("then") == F.col("of"))
    nexts = nexts.select(F.col("range").alias("of_range"), F.col("text").alias("first_text"), F.col("sigs").alias("first_sigs"))
    rows = rows.join(nexts, rows["range"] == nexts["of_range"])
    return rows.select("id", "text", "sigs", F.coalesce("ahead", "first_text").alias("next_text"), F.coalesce("ahead_sigs", "first_sigs").alias("next_sigs"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None) -> DataFrame:
    """with_next, the edited text (its last half taken from the next document) and its set."""
    rows = with_next(docs, id_col, text_col, groups)
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long"))
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    return with_signatures(rows, "edited", "edited_sigs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (id, fingerprint) of every document, and pairs of distinct fingerprints.

    Pairs (a, b, likeness), a < b, are all whose sets have Jaccard of ``threshold`` or more.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    rows = with_signatures(rows, "text", "sigs").select("id", fingerprint(F.col("sigs")).alias("fingerprint"), "sigs")
    rows = settle(rows, "spotsigs")
    return rows.select("id", "fingerprint"), alike(rows, threshold)


def alike(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness), a < b, of the distinct fingerprints of rows (fingerprint, sigs).

    Two sets of n >= m signatures that are alike share one of the first n - ceil(t n) + 1 of the
    larger and of the first m - ceil(2t / (1 + t) m) + 1 of the smaller, in any one order of signatures;
    what follows the first shared one must suffice for the overlap that t asks, which is checked
    where they meet. They lie in one length partition or in neighbouring ones.
    """
    sets = rows.groupBy("fingerprint").agg(F.first("sigs").alias("sigs"))
    sets = settle(sets.select("fingerprint", "sigs", F.size("sigs").alias("n"), F.monotonically_increasing_id().alias("uid")), "spotsigs-sets")
    cell = F.pmod("sig", F.lit(_CELLS)).cast("int")
    common = sets.select(F.explode("sigs").alias("sig")).groupBy(cell.alias("cell")).agg(F.count("*").alias("df"))
    levels = bytearray(_CELLS)
    for r in common.collect():  # at most _CELLS rows of two numbers
        levels[r["cell"]] = min(120, int(4 * math.log2(r["df"] + 1)))
    ranked = F.transform("sigs", lambda s: F.struct(F.substring(F.lit(bytes(levels)), F.pmod(s, F.lit(_CELLS)).cast("int") + 1, F.lit(1)).alias("level"), s.alias("sig")))
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    rare = sets.select("uid", "n", part.alias("part"), F.array_sort(ranked).alias("order"))
    both = 2 * threshold / (1 + threshold)

    def side(of: str, share: float, parts) -> DataFrame:
        prefix = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int"))
        told = rare.select("uid", "n", F.explode(parts).alias("part"), prefix.alias("prefix")).select("uid", "n", "part", F.posexplode("prefix").alias("at", "x"))
        return told.select(F.col("uid").alias(of), F.col("n").alias(f"n{of}"), F.col("at").alias(f"at{of}"), F.col("x.sig").alias("sig"), "part")

    larger, smaller = side("a", threshold, F.array("part", F.col("part") - 1)), side("b", both, F.array("part"))
    sized = (F.col("nb") >= threshold * F.col("na") - 1e-9) & ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    enough = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= both / 2 * (F.col("na") + F.col("nb")) - 1e-9
    # The exploded sides are larger than planned for, so a broadcast of them is ruled out.
    keys = (larger["sig"] == smaller["sig"]) & (larger["part"] == smaller["part"])
    met = settle(larger.join(smaller.hint("merge"), keys & sized & enough).select("a", "b").distinct(), "spotsigs-met")
    left, right = (sets.select(F.col("uid").alias(k), F.col("fingerprint").alias(f"f{k}"), F.col("sigs").alias(f"s{k}")) for k in "ab")
    pairs = met.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-12)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class_id, n_links) of every document: the least id that links reach, itself included,
    and how many different fingerprints its own one is linked with."""
    members, pairs = near_duplicates(docs, id_col, text_col, threshold)
    pairs = settle(pairs.select("a", "b"), "spotsigs-pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.groupBy("a").agg(F.count("*").alias("n_links")).select(F.col("a").alias("of"), "n_links")
    roots = components(pairs)
    firsts = members.groupBy("fingerprint").agg(F.min("id").alias("first"))
    rooted = firsts.join(roots, firsts["fingerprint"] == roots["node"], "left").join(counts, firsts["fingerprint"] == counts["of"], "left")
    rooted = settle(rooted.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "spotsigs-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    named = settle(rooted.join(least, "root").select("fingerprint", "class_id", "n_links"), "spotsigs-named")
    return members.join(named.hint("merge"), "fingerprint").select("id", "class_id", "n_links")
